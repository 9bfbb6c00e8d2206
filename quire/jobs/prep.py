"""Preparing a corpus: numbers, resolved references, contents and findings for all documents at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fields, text
from quire.jobs.folders import dealt
from quire.operators import elements, joins, windows
from quire.sources.corpus import ELEMENT_COLUMNS, explode_elements
from quire.sources.markup import Asked, Path

#: Elements that preparation takes out, beside comments and processing instructions: fixed values.
DROPPED = ("cref",)
PN_PREFIX, SLUG_PREFIX = "section-", "name-"
#: What is read with sections, and with blocks.
COUNTS, BACK = ("counts", Path(counts=("section",), of=("section",))), ("back", ("back",))
SECTIONS = {"firsts": (("name", "name"),), "under": (BACK,), "paths": (COUNTS,)}
BLOCKS = {"under": (BACK, ("apart", windows.NO_NUMBERS)), "paths": (COUNTS, ("places", Path(counts=(*windows.PARAGRAPHS, *windows.COUNTED_ONLY), below=windows.BEGIN_ANEW)))}


@dataclass(frozen=True)
class Prepared:
    """``elements``, ``sections`` (number, pn, title, visible), ``xrefs`` (derived), ``toc``, ``findings`` and ``paragraphs`` (pn) of a corpus.

    Each is a plan of its own that reads the markup once, takes from it only the elements and columns that it needs, and writes no tables. What stands above and below
    an element, and its place among siblings, come with it; ids and the ranks of the contents are windows within one shuffle by document. Marks that
    defaults may give are windows too.
    """

    docs: DataFrame
    defaults: DataFrame | None
    depth: int
    id_col: str
    xml_col: str

    def _read(self, *columns: str, tags: tuple[str, ...] | None = None, values: tuple[str, ...] = (), top_values: tuple[str, ...] = (), **more) -> DataFrame:
        """Elements of these tags with cleaned attributes, those of ``values`` as columns. With defaults, elements of all tags are read: any may have an attribute then."""
        asked = Asked(columns, dropped=DROPPED, tags=tags if self.defaults is None else None, values=tuple((v, v) for v in values), top_values=tuple((f"top_{v}", v) for v in top_values), **more)
        el = explode_elements(self.docs, id_col=self.id_col, xml_col=self.xml_col, asked=asked)
        if "attrs" in columns:
            el = elements.yes_no_to_bool(elements.clean_attrs(el, rename={}))
            if self.defaults is not None:
                el = elements.fill_attr_defaults(el, self.defaults)
        for names, tag in ((values, "tag"), (tuple(f"top_{v}" for v in top_values), "top_tag")):
            if not names:
                continue
            clean = {v: F.trim(v) for v in names}
            clean = {v: F.when(c == "yes", "true").when(c == "no", "false").otherwise(c) for v, c in clean.items()}
            if self.defaults is not None:
                d = F.broadcast(self.defaults.select(F.col("tag").alias("_tag"), F.col("defaults").alias("_d")))  # one row a tag of a fixed vocabulary
                el, clean = el.join(d, F.col(tag) == F.col("_tag"), "left"), {v: F.coalesce(c, F.col("_d")[v.removeprefix("top_") if tag == "top_tag" else v]) for v, c in clean.items()}
            el = el.withColumns(clean).drop("_tag", "_d")
        return el

    @cached_property
    def elements(self) -> DataFrame:
        return self._read(*ELEMENT_COLUMNS).filter("kind <> 'error'")

    @cached_property
    def sections(self) -> DataFrame:
        marks = {} if self.defaults is not None else {"within": (("_hidden", ("section", "toc", "exclude")),), "holds": (("_held", ("section", "toc", "include")),)}
        el = self._read("doc_id", "node_id", "parent_id", "last_desc", "tag", tags=("section",), values=("anchor", "pn", "title", "toc"), **SECTIONS, **marks).filter("tag = 'section'")
        mark, level = F.when(F.col("toc").isin("include", "exclude"), F.col("toc")), F.size("counts")
        sec = el.select("doc_id", "node_id", "parent_id", "last_desc", "anchor", level.alias("level"), F.when(F.col("back"), "back").otherwise("middle").alias("part"), section_number().alias("number"), section_pn().alias("pn"), section_name().alias("name"), mark.alias("mark"), *(c for (c, _), in marks.values()))
        if marks:
            sec = sec.withColumn("visible", windows.is_shown(F.col("_held"), F.col("_hidden"), F.col("level") <= self.depth)).drop("_held", "_hidden")
        else:
            sec = windows.shown(dealt(sec), doc="doc_id", node="node_id", last="last_desc", level=F.col("level"), mark="mark", depth=self.depth)
        return sec.withColumn("slug", slug_of(F.col("name")))

    @cached_property
    def toc(self) -> DataFrame:
        number = F.col("number")
        lines = windows.table_of_contents(self.sections, doc="doc_id", pos=F.col("node_id"), number="number", title="name", level=fields.section_level(number), appendix=F.col("part") == "back", page=F.lit(""))
        return lines.withColumn("line", F.rtrim("line"))

    @cached_property
    def xrefs(self) -> DataFrame:
        el = self._read("doc_id", "node_id", "tag", "text", tags=("section", "xref"), attrs=("anchor",), values=("anchor", "pn", "title", "target", "format"), **SECTIONS)
        x = linked(el.filter("tag IS NOT NULL")).filter(f"link = {XREF} AND best.link < {XREF}")
        derived = joins.derive_xref_content(F.col("format"), F.col("best.tag"), F.col("best.number"), F.col("best.name"), F.col("text"), F.col("best.anchor"))
        kind = F.element_at(F.array(*map(F.lit, ID_KINDS)), F.col("best.link") + 1)
        return x.select("doc_id", "best.node_id", F.col("node_id").alias("xref_id"), F.col("id").alias("target"), "format", "text", kind.alias("id_kind"), "best.tag", "best.anchor", "best.number", "best.name", derived.alias("derived"))

    @cached_property
    def findings(self) -> DataFrame:
        el = self._read("doc_id", "node_id", "tag", "text", tags=("section", "xref", "reference"), attrs=("anchor",), ascii_but=ANY_TEXT, values=("anchor", "pn", "title", "target", "format"), **SECTIONS)
        found = lambda severity, code, *message: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat(*message).alias("message"))
        one = F.when((F.col("link") == ANCHOR) & (F.col("nth") > 1), found("error", "duplicate", F.lit("The id "), "id", F.lit(" again")))
        one = one.when((F.col("link") == XREF) & (F.col("best.link") >= XREF), found("error", "unresolved", F.lit("Nothing has the id "), "id"))
        one = one.when((F.col("link") == REFERENCE) & ~F.col("used"), found("warning", "unused", F.lit("No reference to "), "id"))
        one = one.when(F.col("link") == ODD_TEXT, found("warning", "non-ascii", F.lit("Text of <"), "id", F.lit("> is not ASCII")))
        one = one.when(F.col("link") == UNREAD, found("error", "markup", F.col("id")))
        return linked(el, checks=True).select("doc_id", one.alias("f")).filter("f IS NOT NULL").select("doc_id", "f.*")

    @cached_property
    def paragraphs(self) -> DataFrame:
        blocks = tuple(t for t in windows.PARAGRAPHS if t not in windows.NUMBERED_APART)
        el = self._read("doc_id", "node_id", "tag", "top_tag", tags=blocks, values=("pn",), top=windows.BEGIN_ANEW, top_values=("pn",), **BLOCKS)
        el = el.filter(F.col("tag").isin(*blocks) & F.col("places").isNotNull() & ~F.col("apart"))
        top = F.coalesce(F.col("top_pn"), F.when(F.col("top_tag") == "section", own_pn()), F.lit("unknown-unknown"))
        numbers = F.array_join(F.col("places").cast("array<string>"), ".")
        return el.select("doc_id", "node_id", "tag", F.coalesce(F.col("pn"), F.concat(top, F.lit("-"), numbers)).alias("pn"))


def prepare(docs: DataFrame, *, defaults: DataFrame | None = None, depth: int = 3, id_col: str = "doc_id", xml_col: str = "xml") -> Prepared:
    """Prepares the documents of ``docs``. Documents whose markup can't be read give a finding and nothing else.

    Every result that is used reads ``docs`` once; documents that are dear to make should be written before several results are taken.
    """
    return Prepared(docs, defaults, depth, id_col, xml_col)


def section_number() -> Column:
    return windows.number_of(F.col("counts"), F.col("back"))


def own_pn() -> Column:
    return F.concat(F.lit(PN_PREFIX), F.when(F.col("back"), "appendix.").otherwise(""), section_number())


def section_pn() -> Column:
    return F.coalesce(F.col("pn"), own_pn())


def section_name() -> Column:
    """The text of a section's first name, else its title."""
    return F.coalesce("name", "title", F.lit(""))


def slug_of(name: Column) -> Column:
    return F.concat(F.lit(SLUG_PREFIX), text.slugify(name, "name"))


#: What links rows of a document: ids by their rank, what uses ids, and findings that only pass through.
ID_KINDS = ("anchor", "pn", "slug")
ANCHOR, PN, SLUG, XREF, REFERENCE, ODD_TEXT, UNREAD = range(7)


def linked(el: DataFrame, *, checks: bool = False) -> DataFrame:
    """Ids and what refers to them, a row for each: ``doc_id``, ``id``, ``link`` (what it is), ``node_id``, ``format``, ``text``, ``best``: what the id stands for.

    That is an anchor, else a pn, else a slug, the first in document order. With ``checks`` also references and rows that are findings as they stand,
    ``nth`` (its number among equal anchors) and ``used`` (whether a cross reference has its id). Elements are dealt by document once; a window meets ids with all that names them.
    Pns and slugs that are made have fixed beginnings: documents whose references never begin so need no rows for them.
    """
    tag, name = F.col("tag"), F.col("name")
    section, xref = F.coalesce(tag == "section", F.lit(False)), F.coalesce(tag == "xref", F.lit(False))
    target, made = F.when(xref, F.col("target")), F.when(section & F.col("pn").isNull(), own_pn())
    row = el.select(
        "doc_id", "node_id", "tag", "anchor", target.alias("target"), F.when(xref, F.coalesce("format", F.lit("default"))).alias("format"), F.when(xref | tag.isNull(), F.col("text")).alias("text"),
        F.when(section, section_number()).alias("number"), F.when(section, F.col("pn")).alias("pn"), made.alias("made"), F.when(section, section_name()).alias("name"), *([is_odd().alias("odd")] if checks else []),
    )
    row, doc = dealt(row), W.partitionBy("doc_id")
    row = row.withColumns({"_pns": F.max(F.startswith("target", F.lit(PN_PREFIX))).over(doc), "_slugs": F.max(F.startswith("target", F.lit(SLUG_PREFIX))).over(doc)})
    link = lambda when, what, id_: F.when(when, F.struct(F.lit(what).alias("link"), id_.alias("id")))
    pn, is_anchor = F.coalesce("pn", F.when(F.col("_pns"), F.col("made"))), F.col("anchor").isNotNull()
    links = [link(is_anchor, ANCHOR, F.col("anchor")), link(pn.isNotNull(), PN, pn), link(section & F.col("_slugs"), SLUG, F.when(section & F.col("_slugs"), slug_of(name))), link(xref, XREF, F.col("target"))]
    if checks:
        links += [link((tag == "reference") & is_anchor, REFERENCE, F.col("anchor")), link(F.col("odd"), ODD_TEXT, tag), link(tag.isNull(), UNREAD, F.col("text"))]
    row = row.select("doc_id", "node_id", "tag", "anchor", "number", "name", "format", F.when(xref, F.col("text")).alias("text"), F.inline(F.array_compact(F.array(*links))))
    same = W.partitionBy("doc_id", "id").orderBy("link", "node_id").rowsBetween(W.unboundedPreceding, 0)
    if checks:
        row = row.select("doc_id", "id", "link", "node_id")
        told = {"nth": F.row_number().over(W.partitionBy("doc_id", "id").orderBy("link", "node_id")), "used": F.max(F.col("link") == XREF).over(same), "best": F.struct(F.first("link").over(same).alias("link"))}
        return row.withColumns(told)
    return row.withColumn("best", F.first(F.struct("link", "node_id", "tag", "anchor", "number", "name")).over(same))


#: Elements whose text may hold any character: fixed values.
ANY_TEXT = ("artwork", "author", "city", "code", "country", "email", "name", "organization", "postalLine", "region", "sourcecode", "street", "t", "title", "u", "xref")


def is_odd(allowed: tuple[str, ...] = ANY_TEXT) -> Column:
    """Whether an element outside ``allowed`` has text that isn't ASCII."""
    return ~F.coalesce(F.col("tag").isin(*allowed), F.lit(True)) & ~F.coalesce(text.is_ascii(F.col("text")), F.lit(True))


def non_ascii_findings(el: DataFrame, allowed: tuple[str, ...] = ANY_TEXT) -> DataFrame:
    """A warning for each element outside ``allowed`` whose text isn't ASCII."""
    return el.filter(is_odd(allowed)).select("doc_id", F.lit("warning").alias("severity"), F.lit("non-ascii").alias("code"), F.concat(F.lit("Text of <"), "tag", F.lit("> is not ASCII")).alias("message"))
