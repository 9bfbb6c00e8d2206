"""Text functions: every one takes and returns a Column, and is null for null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that NFKD takes apart into an ASCII letter and marks, and those letters: fixed values.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Characters that is_ascii overlooks: no-break space, zero-width space, no-break hyphen, line separator, word joiner.
FORMAT_CHARS = "\u00a0\u200b\u2011\u2028\u2060"
#: Scripts told apart by ``scripts_used``: fixed values, in order.
SCRIPTS = ("Arabic", "Armenian", "Bengali", "Common", "Cyrillic", "Devanagari", "Georgian", "Greek", "Han", "Hangul", "Hebrew", "Hiragana", "Inherited", "Katakana", "Latin", "Thai")
#: Typographic punctuation and its ASCII spelling, one to one and one to several characters: fixed values.
PUNCTUATION = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00a0": " ", "\u202f": " "}
LONG_PUNCTUATION = {"\u2014": "--", "\u2026": "...", "\u00ab": "<<", "\u00bb": ">>"}
LONG_LETTERS = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Ø": "O", "ø": "o", "Þ": "Th", "þ": "th"}
SPELLINGS = PUNCTUATION | LONG_PUNCTUATION | dict(zip(ACCENTED, PLAIN, strict=True)) | LONG_LETTERS
#: Keywords of requirement levels, longest first where one begins another: fixed values.
KEYWORDS = ("MUST NOT", "MUST", "REQUIRED", "SHALL NOT", "SHALL", "SHOULD NOT", "SHOULD", "NOT RECOMMENDED", "RECOMMENDED", "MAY", "OPTIONAL")


def strip_marks(c: Column) -> Column:
    """Latin letters without their accents; other characters beyond ASCII go. The full NFKD form is in ``helpers``."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def slugify(c: Column, style: str = "selector") -> Column:
    """A slug: "selector" joins with "_", "html" with "-", "name" also drops what isn't ASCII. Letters of any script count as such."""
    if style == "name":
        kept = F.lower(F.btrim(F.regexp_replace(strip_marks(c), r"[^A-Za-z0-9_\s/-]", ""), F.lit(" \t\n\x0b\x0c\r")))
        return F.regexp_replace(kept, r"[-\s/]+", "-")
    join, extra = ("_", "/|@=-") if style == "selector" else ("-", "/|-")
    kept = F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))), rf"[^\p{{L}}\p{{N}}_\s{extra}]", "")
    return F.btrim(F.regexp_replace(kept, rf"[_\s{extra}]+", join), F.lit(join))


def normalize_item_text(c: Column) -> Column:
    """White space to spaces; at most two after a period and one elsewhere; trimmed."""
    c = F.regexp_replace(c, r"[ \t\n\r\f\x0B]", " ")
    c = F.regexp_replace(c, r"\.   +", ".  ")
    return F.btrim(F.regexp_replace(c, r"([^.])  +", "$1 "))


def fold_newlines(c: Column) -> Column:
    """Line ends and the space around them to one space, two after a period; left-trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\.\s*\n\s*", ".  ")
    return F.regexp_replace(c, r"\s*\n\s*", " ")


def normalize_code_lines(c: Column, tab: int = 8) -> Column:
    """Lines without white space at their ends, tabs expanded to multiples of ``tab``."""

    def expand(line: Column) -> Column:
        parts = F.split(line, "\t", -1)
        joined = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda acc, p: F.concat(acc, F.repeat(F.lit(" "), F.lit(tab) - F.length(acc) % tab), p))
        return F.regexp_replace(joined, r"\s+$", "")

    return F.array_join(F.transform(F.split(c, "\n", -1), expand), "\n")


def has_tabs(c: Column) -> Column:
    """Whether ``normalize_code_lines`` expands any tab."""
    return F.contains(c, F.lit("\t"))


def clean_text(c: Column) -> Column:
    """No-break spaces and line separators to spaces, zero-width characters removed, trimmed. The no-break hyphen stays."""
    c = F.translate(c, "\u00a0\u2028", "  ")
    return F.regexp_replace(F.regexp_replace(c, "[\u200b\u2060\ue060]", ""), r"^\s+|\s+$", "")


def is_ascii(c: Column) -> Column:
    """Whether all characters are ASCII, but for five that only format. True for null."""
    return F.coalesce(c.rlike(rf"^[\x00-\x7F{FORMAT_CHARS}]*$"), F.lit(True))


def is_script(c: Column, script: str, ignore: tuple[str, ...] = ("Common", "Inherited"), extra: str = "") -> Column:
    """Whether every character is of ``script`` or an ignored one; ``extra`` is put into the class as it is. True for ''."""
    return c.rlike("^[" + "".join(rf"\p{{Is{s}}}" for s in (script, *ignore)) + extra + "]*$")


def scripts_used(c: Column, scripts: tuple[str, ...] = SCRIPTS) -> Column:
    """The scripts of a text, sorted and joined by commas. ASCII characters count only among the first 100.

    One scan a script, no row for each character: what is looked at is the first 100 characters and all others beyond ASCII.
    """
    seen = F.concat(F.substring(c, 1, 100), F.regexp_replace(F.substring(c, 101, 2**31 - 101), r"[\x00-\x7F]+", ""))
    return F.array_join(F.array_compact(F.array(*[F.when(seen.rlike(rf"\p{{Is{s}}}"), s) for s in sorted(scripts)])), ",")


def _mapped(c: Column, mapping: dict[str, str], charrefs: bool = False, keep: str = "") -> Column:
    """A text with each character of ``mapping`` replaced, and others beyond ASCII but ``keep`` as "&#n;" if asked.

    Characters for characters are one pass over the text, and each of a few longer spellings is one. With many, or references, only a text that still has others to replace is taken apart, once,
    into ASCII runs and single characters, whatever the number of the mapping's entries.
    """
    short, long = ({k: v for k, v in mapping.items() if (len(v) == 1) == one} for one in (True, False))
    t = F.translate(c, "".join(short), "".join(short.values())) if short else c
    if len(long) <= 16 and not charrefs:
        for k, v in long.items():
            t = F.replace(t, F.lit(k), F.lit(v))
        return t
    beyond = "[^\\x00-\\x7F]" if charrefs else "[" + "".join(f"\\x{{{ord(k):X}}}" for k in long) + "]"
    rest = "[\\x00-\\x7F]+" if charrefs else beyond.replace("[", "[^", 1) + "+"
    known = F.create_map(*[F.lit(x) for pair in long.items() for x in pair]) if long else None

    def one(x: Column) -> Column:
        ref = F.concat(F.lit("&#"), F.ascii(x), F.lit(";"))
        out = (F.when(x.isin(*keep), x).otherwise(ref) if keep else ref) if charrefs else x
        return F.when(F.length(x) > 1, x).otherwise(F.coalesce(known[x], F.when(F.ascii(x) > 127, out).otherwise(x)) if long else F.when(F.ascii(x) > 127, out).otherwise(x))

    parts = F.regexp_extract_all(t, F.lit(f"{rest}|{beyond}"), F.lit(0))
    return F.when(t.rlike(beyond), F.array_join(F.transform(parts, one), "")).otherwise(t)


def downcode_punctuation(c: Column) -> Column:
    """Typographic punctuation in ASCII."""
    return _mapped(c, PUNCTUATION | LONG_PUNCTUATION)


#: Control characters but tab, line feed and carriage return, which become spaces.
CONTROLS = {chr(i): " " for i in [*range(9), 11, 12, *range(14, 32), 127]}
#: Characters that stay as they are, for what is done with them later: fixed values.
INTERNAL = "\u00a0\u200b\u2011\u2028\u2060\ue060"


def downcode(c: Column, mapping: dict[str, str] | None = None, charrefs: bool = False) -> Column:
    """Characters beyond ASCII in ASCII spellings, control characters as spaces.

    ``mapping`` (character to spelling) defaults to punctuation and Latin letters; :func:`spellings` makes a larger one. Other
    characters stay, or become "&#n;" with ``charrefs``, but for no-break and zero-width ones.
    """
    return _mapped(c, CONTROLS | (SPELLINGS if mapping is None else mapping), charrefs, INTERNAL)


def charref(c: Column) -> Column:
    """Characters beyond ASCII as "&#n;"."""
    return _mapped(c, {}, charrefs=True)


def spellings() -> dict[str, str]:
    """The ASCII spellings of characters that Unicode takes apart into ASCII and marks, in the Latin, punctuation and letter-like blocks, and :data:`SPELLINGS`."""
    blocks = [range(0xA1, 0x250), range(0x1E00, 0x1F00), range(0x2000, 0x2070), range(0x2100, 0x2190), range(0xFB00, 0xFB07)]
    out = {}
    for code in (i for b in blocks for i in b):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)).replace("\u2044", "/")
        if plain.strip() and plain.isascii():
            out[chr(code)] = plain
    return {k: v for k, v in (out | SPELLINGS).items() if k not in INTERNAL}


#: A code point's eight hexadecimal digits, as four to six.
_CODE = "0000([0-9A-F]{4})|000([0-9A-F]{5})|00([0-9A-F]{6})"


def expand_unicode(c: Column, form: str = "lit-num") -> Column:
    """Up to three parts of num, lit, char joined as "a (b, c)"; num must be among them. Names need ``helpers.character_names``."""
    parts = form.split("-")
    if "num" not in parts or len(parts) > 3 or not set(parts) <= {"num", "lit", "char"}:
        raise ValueError("form is one to three of num, lit and char, with num among them")
    made = {"char": c, "lit": F.concat(F.lit('"'), c, F.lit('"')), "num": F.rtrim(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), _CODE, "U+$1$2$3 "))}
    first, rest = made[parts[0]], [made[p] for p in parts[1:]]
    out = F.concat(first, F.lit(" ("), F.concat_ws(", ", *rest), F.lit(")")) if rest else first
    return F.when(F.length(c) == 0, "").otherwise(out)


def keywords_in(c: Column) -> Column:
    """The requirement keywords of a text, in order."""
    return F.regexp_extract_all(c, F.lit(rf"\b({'|'.join(KEYWORDS)})\b"), F.lit(1))


def is_keyword(c: Column) -> Column:
    """Whether a text is one of the keywords, spaces folded."""
    return F.btrim(F.regexp_replace(c, "[\\s\u00a0]+", " ")).isin(*KEYWORDS)


def list_label(n: Column, style: str) -> Column:
    """The label of item ``n``: decimal (1 d), letters (a A c C: 27 is "ba"), roman (i I, up to 3999, else null), octal (o O), hex (x X)."""
    kind = style.lower()
    if kind in ("1", "d"):
        return n.cast("string")
    if kind in ("o", "x"):
        out = F.conv(n.cast("string"), 10, 8 if kind == "o" else 16)
        return F.upper(out) if style.isupper() else F.lower(out)
    if kind in ("a", "c"):
        digits = F.conv((n - 1).cast("string"), 10, 26)  # 0-9A-P
        out = F.translate(digits, "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")
    elif kind == "i":
        place = lambda one, five, ten: [""] + [one * k for k in (1, 2, 3)] + [one + five] + [five + one * k for k in (0, 1, 2, 3)] + [one + ten]
        tables = [place("i", "v", "x"), place("x", "l", "c"), place("c", "d", "m"), ["", "m", "mm", "mmm"]]
        at = [F.get(F.array(*map(F.lit, t)), (F.floor(n / 10**k) % 10).cast("int")) for k, t in enumerate(tables)]
        out = F.when((n > 0) & (n <= 3999), F.concat(*at[::-1]))
    else:
        raise ValueError(f"no such style: {style}")
    return F.upper(out) if style.isupper() else out


def formatted_label(n: Column, style: str, parent: Column | None = None) -> Column:
    """Labels of a format with ``%`` and a style letter, and ``%p`` for the parent's label."""
    out = F.lit("")
    at = 0
    while at < len(style):
        if style[at] == "%" and at + 1 < len(style):
            out = F.concat(out, F.coalesce(parent, F.lit("")) if style[at + 1] == "p" and parent is not None else F.lit("%") if style[at + 1] == "%" else list_label(n, style[at + 1]))
            at += 2
        else:
            out, at = F.concat(out, F.lit(style[at])), at + 1
    return out


def long_lines_of(c: Column, width: int = 72) -> Column:
    """The lines longer than ``width``: an array of (line_no, text, excess)."""
    rows = F.transform(F.split(c, "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text"), (F.length(x) - width).alias("excess")))
    return F.filter(rows, lambda r: r["excess"] > 0)


def extract_code_blocks(c: Column) -> Column:
    """Code between markers, or from one to the end where none closes it: an array of (file, code)."""
    pattern = r"(?s)<CODE BEGINS>(?: file \"([^\"]*)\")?\n(.*?)(?:\n?<CODE ENDS>|\z)"
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda b: F.struct(F.regexp_extract(b, pattern, 1).alias("file"), F.regexp_extract(b, pattern, 2).alias("code")))


def code_marker_problem(c: Column) -> Column:
    """"missing end" if a code block is not closed, "trailing text" if text follows the last end on its line, else null."""
    opened, closed = F.size(F.split(c, "<CODE BEGINS>")) - 1, F.size(F.split(c, "<CODE ENDS>")) - 1
    return F.when(opened > closed, "missing end").when(c.rlike(r"<CODE ENDS>[ \t]*[^\s]"), "trailing text")


def emit_code_markers(code: Column, file: Column) -> Column:
    """Code with its markers, and the file's name if it has one."""
    return F.concat(F.lit("<CODE BEGINS>"), F.when(file.isNull() | (file == ""), "").otherwise(F.concat(F.lit(' file "'), file, F.lit('"'))), F.lit("\n"), code, F.lit("\n<CODE ENDS>"))


def justify_line(left: Column, center: Column, right: Column, width: int = 72) -> Column:
    """Three parts on one line. Parts that don't fit together: the longest (the first of them) is cut by what is too much."""
    parts = [F.rtrim(left), F.btrim(center), F.btrim(right)]
    lens = [F.length(p) for p in parts]
    over, most = sum(lens) - width, F.greatest(*lens)
    first = [lens[0] == most, (lens[1] == most) & (lens[0] < most), (lens[2] == most) & (lens[0] < most) & (lens[1] < most)]
    a, b, c = (F.when((over > 0) & f, F.substring(p, F.lit(1), n - over)).otherwise(p) for p, n, f in zip(parts, lens, first, strict=True))
    gap = F.lit(width) - F.length(b)
    # an odd length is centred in a width of one more; the odd space goes to the left for odd widths of text and field
    before = F.floor(F.when(F.length(b) % 2 == 0, gap).otherwise(gap + 1) / 2).cast("int")
    after = F.lit(width) - before - F.length(b)
    # parts that overlap: the spaces of one show the next; each part is padded and taken apart once a row
    chars = lambda x: F.split(x, "")
    over_next = lambda x, y: F.zip_with(x, y, lambda m, n: F.when(m != " ", m).otherwise(n))
    mid = F.rpad(F.concat(F.repeat(F.lit(" "), before), b), width, " ")
    laid = F.array_join(over_next(over_next(chars(mid), chars(F.lpad(c, width, " "))), chars(F.rpad(a, width, " "))), "")
    return F.when((F.length(a) <= before) & (F.length(c) <= after), F.concat(F.rpad(a, before, " "), b, F.lpad(c, after, " "))).otherwise(laid)


def align_block(lines: Column, how: str, width: int = 72) -> Column:
    """Lines moved as one block: left, center or right in ``width``."""
    widest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    pad = {"left": F.lit(0), "right": F.greatest(F.lit(width) - widest, F.lit(0)), "center": F.greatest(F.floor((F.lit(width) - widest) / 2), F.lit(0))}[how]
    return F.transform(lines, lambda x: F.concat(F.repeat(F.lit(" "), pad.cast("int")), x))


def indent_block(lines: Column, indent: int = 3, hang: int = 0) -> Column:
    """Lines indented, those after the first by ``hang`` more; empty ones stay empty."""
    return F.transform(lines, lambda x, i: F.when(x == "", x).otherwise(F.concat(F.repeat(F.lit(" "), F.when(i > 0, indent + hang).otherwise(indent)), x)))
