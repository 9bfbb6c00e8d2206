"""What built-in functions can't express: small helpers over Arrow batches, and groups whose order decides the result."""

from __future__ import annotations

import itertools
import re
import textwrap
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strings(f):
    """A pandas UDF of a function from string to string; null for null."""

    @F.pandas_udf("string")
    def udf(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else f(x))

    return udf


def name_slug(s: str) -> str:
    """NFKD, ASCII only, other marks dropped, spaces, slashes and hyphens to one hyphen."""
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    return re.sub(r"[-\s/]+", "-", re.sub(r"[^\w\s/-]", "", s).strip().lower())


def slugify_nfkd(c: Column) -> Column:
    """The slug of a name, for any script that NFKD can take apart."""
    return _strings(name_slug)(c)


class _Names(dict):
    """The name of each character that came up so far: each is looked up once."""

    def __missing__(self, x: str) -> str:
        self[x] = name = unicodedata.name(x, f"U+{ord(x):04x}")
        return name


def in_pieces(texts: pd.Series, f, most: int = 1_000_000) -> Iterator[pd.Series]:
    """``f`` of each text (null for null), in series of texts that have about ``most`` characters together: results much longer than texts never stand in memory for a whole batch."""
    out, size = [], 0
    for x in texts:
        out.append(None if x is None else f(x))
        size += 0 if x is None else len(x)
        if size >= most or len(out) >= 10_000:
            yield pd.Series(out, dtype=object)
            out, size = [], 0
    if out:
        yield pd.Series(out, dtype=object)


def character_names(c: Column) -> Column:
    """The Unicode names of a text's characters, joined by commas; those without one as "U+xxxx". Names are some twenty times as long as the text."""

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = _Names()
        for part in parts:
            yield from in_pieces(part, lambda s: ", ".join(map(names.__getitem__, s)))

    return udf(c)


# -- wrapping

#: Abbreviations whose period ends no sentence: fixed values. Any three letters such as "Fig." are one too.
ABBREVIATIONS = ("Eq", "Cf", "cf", "vs", "resp", "viz", "ibid", "Jr", "Sr", "Mr", "Ms", "Messrs", "Mmes", "Dr", "Prof", "Profs", "St", "Lt", "a.k.a", "i.e", "e.g")
#: Marks that may stand after a sentence's end, before it, and before its first word: fixed values.
_AFTER, _BEFORE, _OPENING = ("'", '"', ")", "]"), "'\")]>", "\"'(["
#: Words that stay on the line of the next one: fixed values.
KEPT = ("Section", "Appendix", "Figure", "Table")
_SPACE = re.compile("[ \t\n\r\f\v]+")
_NBSP, _ZWSP, _JOINERS = "\u00a0", "\u200b", "\u200c\u2060\ue060"


def _words(paragraph: str) -> list[str]:
    """The words between ASCII spaces; one of ``KEPT`` and its successor are one."""
    words = list(filter(None, _SPACE.split(paragraph)))
    if not any(x in paragraph for x in KEPT):
        return words
    out: list[str] = []
    for word in words:
        if out and out[-1].endswith(KEPT):
            out[-1] += _NBSP + word
        else:
            out.append(word)
    return out


def _may_break(word: str, i: int) -> bool:
    """Whether a line may end between a word's characters i - 1 and i.

    After a slash inside a word; after a hyphen between two parts of two characters or more, neither of which is a number at
    the hyphen; before and after a dash of two hyphens or more; at a zero-width space. Not beside joiners.
    """
    left, right = word[i - 1], word[i]
    if right in _JOINERS or right == _NBSP:
        return False
    if left == _ZWSP:
        return True
    if left == "/":
        return i > 1 and word[i - 2].isalnum() and right.isascii() and right.isalpha()
    if word[i : i + 2] == "--" and left != "-":
        return word[i:].strip("-") != "" and not left.isspace()
    if left != "-" or not right.isalnum():
        return False
    if word[i - 2 : i] == "--":
        return i > 2
    part = word[:i].rstrip("-")
    return len(part) > 1 and part[-1].isalpha() and part[-2].isalnum() and i + 1 < len(word) and not (right.isdigit() and word[i + 1].isdigit())


def _parts(word: str) -> list[str]:
    """A word cut where lines may end. Links stay whole."""
    scheme, found, _ = word.lstrip("<").partition("://")
    if found and scheme.isalpha() and scheme.islower():
        return [word]
    at = [0, *[i for i in range(1, len(word)) if _may_break(word, i)], len(word)]
    return [word[i:j] for i, j in zip(at, at[1:], strict=False)]


def ends_sentence(word: str) -> bool:
    """Whether a word ends a sentence: a full stop, question or exclamation mark after a letter, digit or closing mark, one closing mark at most after it, and no abbreviation."""
    core = word[:-1] if word[-1:] in _AFTER else word
    if len(core) < 2 or core[-1] not in ".!?" or not ((core[-2].isascii() and core[-2].isalnum()) or core[-2] in _BEFORE):
        return False
    stem = word.removesuffix(".")
    stem = stem[1:] if stem[:1] in ("(", "[") else stem
    short = len(stem) == 3 and stem.isascii() and stem.isalpha() and stem.istitle()
    return not (word.endswith(".") and (short or stem in ABBREVIATIONS))


def starts_sentence(word: str) -> bool:
    """Whether a word begins with a capital, opening marks aside."""
    first = word.lstrip(_OPENING)[:1]
    return first.isascii() and first.isupper()


def _shown(word: str) -> str:
    """A word without the marks that only say where it may break."""
    return word if word.isascii() else word.translate(_UNSEEN)


_UNSEEN = dict.fromkeys(map(ord, _JOINERS + _ZWSP))


class _Told(dict):
    """Of each word what wrapping asks: its parts, whether it shows anything, ends a sentence, begins one. Each word is looked at once."""

    def __missing__(self, word: str) -> tuple[list[str], bool, bool, bool]:
        shown = _shown(word)
        parts = [x for x in map(_shown, _parts(word) if "-" in word or "/" in word or _ZWSP in word else [word]) if x]
        seen = shown.strip() != ""
        told = parts, seen, seen and ends_sentence(shown.split()[-1]), starts_sentence(shown)
        if len(self) >= 200_000:  # words without end: begin anew
            self.clear()
        if len(word) <= 100:
            self[word] = told
        return told


_TOLD = _Told()


def wrap_lines(text: str, width: int = 72, indent: int = 0, hang: int = 0) -> list[str]:
    """The lines of a text. Two spaces between sentences, one elsewhere; "Section 3" and the like stay together.

    Words longer than a line are cut. A line separator starts a new line, without the first line's indent.
    """
    rest = " " * (indent + hang)
    room = max(1, width - len(rest))
    lines: list[str] = []
    for k, para in enumerate(text.split("\u2028")):
        line, blank = " " * (0 if k else indent), True
        last = ended = False  # whether there is a word before, whether it ends a sentence
        for word in _words(para.strip()):
            parts, seen, ends, starts = _TOLD[word]
            gap = ("  " if ended and starts else " ") if last else ""
            if len(parts) > 1 or len(word) > room:
                parts = [part[i : i + room] for part in parts for i in range(0, len(part), room)]
            for cut in parts:
                if blank:
                    line += cut
                    blank = not line.strip()
                elif len(line) + len(gap) + len(cut) > width:
                    lines.append(line.rstrip(" "))
                    line = rest + cut
                    blank = not line.strip()
                else:
                    line += gap + cut
                gap = ""
            if seen:
                last, ended = True, ends
        lines.append(line.rstrip(" "))
    return [x.replace(_NBSP, " ") for x in lines] if _NBSP in text or any(x in text for x in KEPT) else lines


def wrap_text(c: Column, width: int = 72, indent: int = 0, hang: int = 0) -> Column:
    """The lines of a paragraph as an array. Split documents into paragraphs first, so that a long one is no single task."""

    @F.pandas_udf("array<string>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else wrap_lines(x, width, indent, hang))

    return udf(c)


def fill_plain(c: Column, width: int = 72) -> Column:
    """Lines by the standard library's rules alone: spaces only, long words kept whole."""

    @F.pandas_udf("array<string>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False))

    return udf(c)


# -- groups


def grow_slugs(slugs: list[str], short: int = 32, long: int = 40) -> list[str | None]:
    """Unique slugs in order: cut to ``short``, grown up to ``long`` to become unique, then numbered up to 99; null beyond."""
    seen: set[str] = set()
    out: list[str | None] = []
    for slug in slugs:
        sizes = range(short, max(short, min(long, len(slug))) + 1)
        cut = next((slug[:n] for n in sizes if slug[:n] not in seen), None)
        if cut is None:
            cut = next((f"{slug[: sizes[-1]]}-{m}" for m in range(2, 100) if f"{slug[: sizes[-1]]}-{m}" not in seen), None)
        if cut is not None:
            seen.add(cut)
        out.append(cut)
    return out


def page_breaks(blank: list[bool], block: list[int | None], keep: list[bool], first: int = 52, height: int = 48, few: int = 2) -> list[int]:
    """The page of each line, 0 for blank lines dropped at a page's top.

    Pages end after ``first`` and then ``height`` lines, earlier if a block would leave up to ``few`` lines alone at the end
    of a page or the top of the next, or would be cut though it is to be kept whole and fits on a page.
    """
    n, pages, start, page = len(blank), [0] * len(blank), 0, 1
    spans: dict[int, list[int]] = {}
    for i, b in enumerate(block):
        if b is not None:
            spans.setdefault(b, [i, i])[1] = i + 1
    room = first
    while start < n:
        stop = min(start + room, n)
        if stop < n and (b := block[stop]) is not None:
            beg, end = spans[b]
            before, after = stop - beg, end - stop
            whole = keep[beg] and end - beg <= height
            alone = 0 < before <= few or (0 < after <= few and end - beg > after)
            if before > 0 and beg > start and (whole or alone):
                stop = beg if whole or before <= few or after <= few else stop
        for i in range(start, stop):
            pages[i] = page
        start, page, room = stop, page + 1, height
        while start < n and blank[start]:
            start += 1
    return pages


def numbered(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A number for each key, the same for equal ones; null is a key."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return keys.dictionary_encode(null_encoding="encode").indices.to_numpy()


def whole_groups(parts: Iterator[pa.RecordBatch], key: str, least: int = 10_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches whose rows stand group by group; ``least`` rows or more each, but for the last one."""
    done: list[pa.RecordBatch] = []
    going: list[pa.RecordBatch] = []  # rows of the group that may go on
    for part in parts:
        if not part.num_rows:
            continue
        if going and going[-1][key][0].as_py() != part[key][0].as_py():
            done, going = done + going, []
        numbers = numbered(part[key])
        if cut := int(np.argmax(numbers == numbers[-1])):
            done, going = [*done, *going, part.slice(0, cut)], []
        going.append(part.slice(cut))
        if sum(x.num_rows for x in done) >= least:
            yield pa.Table.from_batches(done)
            done = []
    if done or going:
        yield pa.Table.from_batches(done + going)


def group_starts(keys: pa.ChunkedArray) -> list[int]:
    """Where each group begins, and the number of rows."""
    numbers = numbered(keys)
    return [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]


def assign_pages(lines: DataFrame, *, doc: str, pos: str, text: str, block: str, keep: str, height: int = 48, first: int = 52) -> DataFrame:
    """``doc``, ``pos``, ``page`` (0 for dropped blank lines). Only flags and block numbers are dealt by document, never texts; a task reads them in order and holds a document's at a time.

    Lines of a null document are those of one document.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(parts, "doc"):
            at, blank, blocks, keeps = group_starts(t["doc"]), *(t[c].to_pylist() for c in ("blank", "block", "keep"))
            out = [page for i, j in itertools.pairwise(at) for page in page_breaks(blank[i:j], blocks[i:j], keeps[i:j], first, height)]
            yield from t.select(["doc", "pos"]).append_column("page", pa.array(out, pa.int32())).to_batches()

    src = lines.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), (F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank"), F.col(block).cast("long").alias("block"), F.coalesce(keep, F.lit(False)).alias("keep"))
    kinds = dict(src.dtypes)
    out = src.repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(run, f"doc {kinds['doc']}, pos {kinds['pos']}, page int")
    return out.select(F.col("doc").alias(doc), F.col("pos").alias(pos), "page")


def grid(cells: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Row and column of each cell (row, colspan, rowspan), in order: the first free place of its row."""
    below: dict[int, set[int]] = {}  # what cells take in rows after their own
    free: dict[int, int] = {}  # no place of the row before this one is free: what is taken stays so
    out = []
    for row, colspan, rowspan in cells:
        mine, col = below.get(row, ()), free.get(row, 0)
        while col in mine:
            col += 1
        out.append((row, col))
        free[row] = col + max(colspan, 0) if rowspan > 0 else col
        for i in range(row + 1, row + rowspan):
            below.setdefault(i, set()).update(range(col, col + colspan))
    return out


def place_cells(cells: DataFrame, *, table: str, row: str, pos: str, colspan: str = "colspan", rowspan: str = "rowspan") -> DataFrame:
    """``table``, ``row``, ``pos``, ``col``: where cells are under spans. A task reads tables one after another, without their texts, and holds those of a batch. Cells of a null table are those of one table."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(parts, "tab"):
            at, cells = group_starts(t["tab"]), list(zip(*(t[c].to_pylist() for c in ("row", "colspan", "rowspan")), strict=True))
            out = [col for i, j in itertools.pairwise(at) for _, col in grid(cells[i:j])]
            yield from t.select(["tab", "row", "pos"]).append_column("col", pa.array(out, pa.int32())).to_batches()

    src = cells.select(F.col(table).alias("tab"), F.col(row).cast("int").alias("row"), F.col(pos).cast("int").alias("pos"), F.col(colspan).cast("int").alias("colspan"), F.col(rowspan).cast("int").alias("rowspan"))
    out = src.repartition("tab").sortWithinPartitions("tab", "row", "pos").mapInArrow(run, f"tab {dict(src.dtypes)['tab']}, row int, pos int, col int")
    return out.select(F.col("tab").alias(table), F.col("row").alias(row), F.col("pos").alias(pos), "col")


def fetches(times: list[float], ttl: float, last: float | None = None) -> list[bool]:
    """Which of the sorted times fetch anew: the first, and each that is more than ``ttl`` seconds after the last fetch."""
    out = []
    for t in times:
        new = last is None or t - last > ttl
        last = t if new else last
        out.append(new)
    return out


def batched(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The batches of a group as one frame."""
    frames = list(parts)
    return pd.concat(frames) if frames else pd.DataFrame()
