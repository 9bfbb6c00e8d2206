"""Names, dates, section numbers, links and attributes: every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import is_script

#: Month names: fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


# -- names


def _dotted(initials: Column, latin: bool = True) -> Column:
    more = (initials != "") & ~initials.endswith(".")
    return F.when(more & is_script(initials, "Latin") if latin else more, F.concat(initials, F.lit("."))).otherwise(initials)


def initials_of(initials: Column, rfc_number: Column | None = None) -> Column:
    """Initials; only the first one where the document's number is 1272 or less."""
    if rfc_number is None:
        return initials
    old = rfc_number.rlike("^[0-9]+$") & (rfc_number.try_cast("int") <= 1272)
    return F.when(F.coalesce(old, F.lit(False)), F.substring_index(initials, ".", 1)).otherwise(initials)


def name_parts(initials: Column, surname: Column, fullname: Column, rfc_number: Column | None = None) -> Column:
    """(initials, surname): as given, with a dot added, or made from a full name in Latin script of two words or more."""
    ini = initials_of(initials, rfc_number)
    words = F.filter(F.split(fullname, r"\s+"), lambda w: w != "")
    short = F.array_join(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.when(F.length(w) > 1, F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))).otherwise(F.upper(w))), " ")
    made = is_script(fullname, "Latin") & (F.size(words) > 1)
    null = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("initials"), b.alias("surname"))
    return F.when(ini.isNotNull() & surname.isNotNull(), pair(_dotted(ini), surname)).when(F.coalesce(fullname, F.lit("")) == "", pair(null, null)).when(made, pair(short, F.element_at(words, -1))).otherwise(pair(null, fullname))


def short_name(initials: Column, surname: Column, fullname: Column, rfc_number: Column | None = None) -> Column:
    """Initials and surname, whichever there are."""
    p = name_parts(initials, surname, fullname, rfc_number)
    return F.array_join(F.filter(F.array(p["initials"], p["surname"]), lambda x: x.isNotNull() & (x != "")), " ")


def full_name(initials: Column, surname: Column, fullname: Column) -> Column:
    """The full name, or else initials and surname."""
    made = F.array_join(F.filter(F.array(_dotted(initials), surname), lambda x: x.isNotNull() & (x != "")), " ")
    return F.when(F.coalesce(fullname, F.lit("")) != "", fullname).otherwise(made)


def ref_name_first(initials: Column, surname: Column, fullname: Column, organization: Column) -> Column:
    """Surname, then initials; the organization where there is no name."""
    p = name_parts(initials, surname, fullname)
    name = F.array_join(F.filter(F.array(p["surname"], p["initials"]), lambda x: x.isNotNull() & (x != "")), ", ")
    return F.when(name != "", name).otherwise(F.coalesce(organization, F.lit("")))


def ref_name_last(initials: Column, surname: Column, fullname: Column, organization: Column) -> Column:
    """Initials, then surname; the organization where there is no name."""
    name = short_name(initials, surname, fullname)
    return F.when(name != "", name).otherwise(F.coalesce(organization, F.lit("")))


# -- dates


def normalize_month(c: Column) -> Column:
    """Two digits for the first month that the text begins, in any case; other texts stay as they are."""
    low = F.lower(c)
    out = None
    for i, m in enumerate(MONTHS, 1):
        hit = (F.length(c) > 0) & F.lit(m.lower()).startswith(low)
        out = F.when(hit, f"{i:02d}") if out is None else out.when(hit, f"{i:02d}")
    return out.otherwise(c)


def format_date_iso(year: Column, month: Column, day: Column) -> Column:
    """As much of year-month-day as there is; null without a year."""
    y, m, d = F.format_string("%4d", year.cast("int")), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    return F.when(year.isNull(), None).when(month.isNotNull() & day.isNotNull(), F.concat_ws("-", y, m, d)).when(month.isNotNull(), F.concat_ws("-", y, m)).otherwise(y)


def format_date(year: Column, month: Column, day: Column, legacy: bool = False) -> Column:
    """"3 May 2024", "May 2024" or "2024"; "May 3, 2024" the legacy way; '' without a year."""
    name = F.get(F.array(*map(F.lit, MONTHS)), month.cast("int") - 1)
    y, d = year.cast("string"), day.cast("string")
    whole = F.concat(name, F.lit(" "), d, F.lit(", "), y) if legacy else F.concat_ws(" ", d, name, y)
    return F.when(month.isNotNull() & day.isNotNull(), whole).when(month.isNotNull(), F.concat_ws(" ", name, y)).otherwise(F.coalesce(y, F.lit("")))


def augment_date(year: Column, month: Column, day: Column, today: Column) -> Column:
    """(year, month, day) with today's year where there is none, and today's month in today's year."""
    y = F.coalesce(year, F.year(today))
    return F.struct(y.alias("year"), F.coalesce(month, F.when(y == F.year(today), F.month(today))).alias("month"), day.alias("day"))


def expiry_date(year: Column, month: Column, day: Column, today: Column, days: int = 185, legacy: bool = False) -> Column:
    """The date and ``days`` more. Without a day: the last one of a past month, today's in this one, the first of a later one.

    ``legacy`` takes, for a later month, the weekday number of its first day (Monday is 0, and gives no date) as the day.
    """
    first = F.make_date(year, month, F.lit(1))
    this = F.trunc(today, "month")
    later = F.weekday(first) if legacy else F.lit(1)
    d = F.coalesce(day, F.when(first < this, F.day(F.last_day(first))).when(first == this, F.day(today)).otherwise(later))
    return F.date_add(F.when(d > 0, F.make_date(year, month, d)), days)


def date_findings(year: Column, month: Column, day: Column, today: Column, published: bool = False) -> Column:
    """What is wrong with a date of three texts, as an array of (severity, code); empty where nothing is.

    "short month": its name has less than three letters. "no month": there is only a year, and it is not today's. "invalid":
    there is no such day. "not today": more than three days away, unless published. Today's year, and month with day, stand
    for missing ones, the first for a missing day of a month. Empty texts are missing; so are nulls.
    """
    y, m, d = (F.when(F.trim(c) != "", F.trim(c)) for c in (year, month, day))
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    named = ~m.rlike("^[0-9]+$")
    at_year = F.coalesce(y, F.year(today).cast("string"))
    number = F.when(m.isNull(), F.date_format(today, "MM")).otherwise(two(F.when(named, normalize_month(m)).otherwise(m)))
    in_month = F.when(m.isNull(), F.date_format(today, "dd")).otherwise(two(F.coalesce(d, F.lit("1"))))
    at = F.try_to_date(F.concat_ws("-", at_year, number, in_month), "yyyy-MM-dd")
    code = lambda when, severity, name: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("code")))
    return F.array_compact(
        F.array(
            code(named & (F.length(m) < 3), "error", "short month"),
            code(m.isNull() & (at_year != F.year(today).cast("string")), "warning", "no month"),
            code(at.isNull(), "error", "invalid"),
            code((F.abs(F.datediff(at, today)) > 3) & F.lit(not published), "warning", "not today"),
        )
    )


# -- section numbers


def split_pn(pn: Column) -> Column:
    """(kind, section, paragraph) of "section-1.2-3"; a leading appendix, boilerplate, note or toc leaves the section number."""
    p = F.split(pn, "-", 3)
    sect = F.get(p, F.lit(1))
    return F.struct(F.get(p, F.lit(0)).alias("kind"), F.regexp_replace(sect, r"^(appendix|boilerplate|note|toc)\.", "").alias("section"), F.get(p, F.lit(2)).alias("paragraph"))


def section_level(number: Column) -> Column:
    """The depth of a section number; a dot at the end doesn't count."""
    return F.size(F.split(F.regexp_replace(number, r"\.+$", ""), r"\.", -1))


def is_appendix(pn: Column) -> Column:
    return pn.rlike(r"^section-([a-z]|appendix)\.")


def fragment_id(pn: Column) -> Column:
    """The HTML id of a part number: "appendix-A.1-2" for appendices, else the number itself."""
    p = split_pn(pn)
    num = F.array_join(F.transform(F.split(p["section"], r"\."), lambda x: F.initcap(x)), ".")
    tail = F.when(F.coalesce(p["paragraph"], F.lit("")) == "", "").otherwise(F.concat(F.lit("-"), p["paragraph"]))
    return F.when(is_appendix(pn), F.concat(F.lit("appendix-"), num, tail)).otherwise(pn)


def without_revision(name: Column) -> Column:
    """A draft's name without "-NN" at its end."""
    return F.regexp_replace(name, r"-[0-9]{2}$", "")


def docname_problem(name: Column, series: Column | None = None) -> Column:
    """What is wrong with a document's name, or null: a dot, no revision, or not the value that the series gives."""
    out = F.when(F.contains(name, F.lit(".")), "dot").when(~name.rlike(r"-[0-9]{2}$"), "no revision")
    return out if series is None else out.when(series.isNotNull() & (series != name), "differs")


# -- links and attributes


def rewrite_links(c: Column, rules: dict[str, str]) -> Column:
    """Links to a host of ``rules`` become its new base and the last step of their path."""
    out = None
    for host, base in rules.items():
        hit, to = F.parse_url(c, F.lit("HOST")) == host, F.concat(F.lit(base), F.substring_index(F.parse_url(c, F.lit("PATH")), "/", -1))
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out.otherwise(c) if out is not None else c


def section_link(url: Column, section: Column) -> Column:
    """A link to a section ("#section-1.2") or an appendix ("#appendix-B") of a document."""
    kind = F.when(section.rlike("^[0-9]"), "#section-").otherwise("#appendix-")
    title = F.array_join(F.transform(F.split(section, r"\."), lambda x: F.initcap(x)), ".")
    return F.concat(F.substring_index(url, "#", 1), kind, title)


def urlkeep(c: Column, most: int = 72, mark: str = "\ue060") -> Column:
    """``mark`` after each "/", "-" and ":" of URLs of at most ``most`` characters, so that lines don't break there."""
    pieces = F.regexp_extract_all(c, F.lit(r"(https?:\S*|(?:(?!https?:)[\s\S])+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^https?:") & (F.length(p) <= most), F.regexp_replace(p, "([/:-])", f"$1{mark}")).otherwise(p)), "")


def data_url(mime: Column, data: Column, base64: bool = False) -> Column:
    """A data: URL; base64 in one line, or percent-encoded but for letters, digits and _.-~/"""
    if base64:
        one_line = F.translate(F.base64(data.cast("binary")), "\r\n", "")  # Spark cuts lines of 76 characters
        return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.url_encode(one_line), F.lit("%2F"), F.lit("/")))
    quoted = F.replace(F.replace(F.replace(F.replace(F.url_encode(data), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit("data:"), mime, F.lit(","), quoted)


def src_problem(path: Column, schemes: tuple[str, ...] = ("data", "file", "http", "https")) -> Column:
    """What is wrong with a source path, or null: "scheme", "shell" characters, or "outside" the folder of the source."""
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    steps = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda a, s: F.struct((a["depth"] + _step(s)).alias("depth"), F.least(a["least"], a["depth"] + _step(s)).alias("least")))
    out = F.when((scheme != "") & ~F.lower(scheme).isin(*schemes), "scheme").when(scheme != "", None)
    # fixed values: characters that a shell reads
    return out.when(path.rlike(r"[><*\[`$|;&(#]"), "shell").when(path.startswith("/") | (steps["least"] < 0), "outside")


def _step(s: Column) -> Column:
    return F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)


def parse_pi(c: Column) -> Column:
    """A map of the key="value" pairs in a text; of a key given twice the last counts."""
    pattern = F.lit(r"([^\s=\"']+)=[\"']([^\"']*)[\"']")
    keys, values = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    keep = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i)))
    pairs = F.transform(keep, lambda i: F.struct(F.get(keys, i).alias("key"), F.get(values, i).alias("value")))
    return F.when(F.size(keys) == 0, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs))


def sanitize_id(c: Column) -> Column:
    """An id: a first character that isn't a letter or "_", and others outside the alphabet of ids, become "_"."""
    return F.regexp_replace(F.regexp_replace(c, "^[^A-Za-z_]", "_"), "[^-._A-Za-z0-9]", "_")


# -- references


def format_reference(label: Column, authors: Column, title: Column, series: Column, date: Column, target: Column) -> Column:
    """"[label] authors, "title", series, date, <target>." with the parts that there are."""
    parts = F.concat_ws(", ", authors, F.concat(F.lit('"'), title, F.lit('"')), series, date, F.concat(F.lit("<"), target, F.lit(">")))
    return F.concat(F.lit("["), label, F.lit("] "), parts, F.lit("."))


def render_xref(content: Column, ref: Column, is_ref: Column, fmt: Column, section: Column, section_format: Column) -> Column:
    """A cross reference as text: "[ref]", "text [ref]", "text (ref)"; with a section "Section 2 of [ref]" and the other forms.

    Without ``ref`` and section it is the text alone.
    """
    lead = F.when(content == "", "").otherwise(F.concat(content, F.lit(" ")))
    tag = F.concat(F.lit("["), ref, F.lit("]"))
    # fixed values: which numbers are sections and which appendices
    label = F.concat(F.when(section.rlike("^[0-9]"), "Section").when(section.rlike(r"^[A-Z](\.|$)"), "Appendix").otherwise("Part"), F.lit(" "), section)
    plain = F.when(fmt == "none", lead).when(is_ref & (fmt == "title"), F.when(content == "", ref).otherwise(F.concat(lead, F.lit("("), ref, F.lit(")")))).when(is_ref, F.concat(lead, tag)).otherwise(F.when(content == "", ref).otherwise(F.concat(lead, F.lit("("), ref, F.lit(")"))))
    deep = F.when(section_format == "of", F.concat(label, F.lit(" of "), lead, tag)).when(section_format == "comma", F.concat(lead, tag, F.lit(", "), label)).when(section_format == "parens", F.concat(lead, tag, F.lit(" ("), label, F.lit(")"))).when(content == "", section).otherwise(F.concat(section, F.lit(" ("), content, F.lit(")")))
    plain = F.when(F.coalesce(ref, F.lit("")) == "", F.btrim(content)).otherwise(plain)
    return F.when(section.isNull(), plain).otherwise(deep)
