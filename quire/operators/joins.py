"""Look-ups between tables: references, ids, includes, rules, ranges and trees."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.fields import parse_pi
from quire.jobs.folders import dealt


def insert_missing(rows: DataFrame, docs: DataFrame, required: DataFrame, *, key: str, kind: str, doc: str) -> DataFrame:
    """``rows`` (doc, kind, ...) and a row for each document and required kind that has none; other columns are null there.

    ``required`` is a small fixed list, so the product has a few rows for each document.
    """
    wanted = docs.select(F.col(key).alias(doc)).distinct().join(F.broadcast(required.select(kind)), how="cross")
    return rows.unionByName(wanted.join(rows, [doc, kind], "left_anti"), allowMissingColumns=True)


def resolve_xrefs(xrefs: DataFrame, ids: DataFrame, *, doc: str = "doc_id", target: str = "target") -> DataFrame:
    """``xrefs`` with ``id_kind`` and ``node_id`` of what they point to: an anchor, else a pn, else a slug; the first in document order.

    ``ids``: doc, id, id_kind, node_id. One row for each id is chosen before the join, so nothing multiplies.
    """
    rank = F.when(F.col("id_kind") == "anchor", 0).when(F.col("id_kind") == "pn", 1).otherwise(2)
    best = ids.groupBy(F.col(doc).alias("_doc"), F.col("id").alias("_id")).agg(F.min(F.struct(rank.alias("r"), "node_id", "id_kind")).alias("_b"))
    out = xrefs.join(best, (F.col(doc) == F.col("_doc")) & (F.col(target) == F.col("_id")), "left")
    return out.select(*xrefs.columns, F.col("_b.id_kind").alias("id_kind"), F.col("_b.node_id").alias("node_id"))


def unresolved(xrefs: DataFrame, ids: DataFrame, *, on: dict[str, str]) -> DataFrame:
    """Rows of ``xrefs`` without a match in ``ids``; ``on`` maps columns of the one to columns of the other."""
    right = ids.select(*[F.col(b).alias(f"_{b}") for b in on.values()]).distinct()
    cond = None
    for a, b in on.items():
        test = F.col(a) == F.col(f"_{b}")
        cond = test if cond is None else cond & test
    return xrefs.join(right, cond, "left_anti")


def unused_references(refs: DataFrame, xrefs: DataFrame, *, on: dict[str, str]) -> DataFrame:
    """References that no cross reference names, by their raw anchor only."""
    return unresolved(refs, xrefs, on=on)


def derive_xref_content(fmt: Column, kind: Column, counter: Column, title: Column, text: Column, label: Column) -> Column:
    """A cross reference's derived text by format: counter, title, none, or the default for its target's kind.

    References give their label; sections, tables and figures "Section 1.2" and the like; anything else its text.
    """
    default = F.when(kind == "reference", label).when(kind.isin("section", "table", "figure"), F.concat(F.initcap(kind), F.lit(" "), counter)).otherwise(F.coalesce(text, title, label))
    return F.when(fmt == "none", "").when(fmt == "counter", counter).when(fmt == "title", F.coalesce(title, label)).otherwise(default)


def display_names(refs: DataFrame, displays: DataFrame, *, doc: str = "doc_id", anchor: str = "anchor", pos: str = "pos", symbolic: bool = True) -> DataFrame:
    """``refs`` with ``display``: the name given for display, else the anchor, or 1 to n where references aren't symbolic."""
    d = displays.select(F.col(doc).alias("_doc"), F.col("target").alias("_t"), F.col("to").alias("_to"))
    if not symbolic:
        return refs.withColumn("display", F.row_number().over(W.partitionBy(doc).orderBy(pos)).cast("string"))
    out = refs.join(d, (F.col(doc) == F.col("_doc")) & (F.col(anchor) == F.col("_t")), "left")
    return out.select(*refs.columns, F.coalesce("_to", anchor).alias("display"))


def duplicate_displays(displays: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Display names that a document gives twice or more: an error."""
    return displays.groupBy(doc, "to").agg(F.count("*").alias("n")).filter("n > 1")


def lookup_with_fallback(requests: DataFrame, library: DataFrame, *, key: str, name: str, priority: str) -> DataFrame:
    """The library row of the best (lowest) priority for each request; names match with or without ".xml", in any case."""
    norm = lambda c: F.lower(F.regexp_replace(F.btrim(c), r"\.xml$", ""))
    rest = [c for c in library.columns if c not in (name, priority)]
    best = library.groupBy(norm(F.col(name)).alias("_name")).agg(F.min(F.struct(F.col(priority).alias("p"), *rest)).alias("_b"))
    out = requests.join(best, norm(F.col(key)) == F.col("_name"), "left")
    return out.select(*requests.columns, F.col("_b.p").alias(priority), *[F.col(f"_b.{c}").alias(c) for c in rest])


def nearest_ancestor(el: DataFrame, ancestors: DataFrame, *, value: str, doc: str = "doc_id", default: Column | None = None) -> DataFrame:
    """``el`` with ``value`` of the nearest enclosing element among ``ancestors`` (doc, node_id, depth, value).

    Only decisive ancestors are joined, and only ids are exploded.
    """
    a = ancestors.select(F.col(doc).alias("_doc"), F.col("node_id").alias("_anc"), F.col("depth").alias("_depth"), F.col(value).alias("_value"))
    up = el.select(F.col(doc).alias("_d"), F.col("node_id").alias("_n"), F.explode("anc_ids").alias("_a"))
    found = up.join(a, (F.col("_d") == F.col("_doc")) & (F.col("_a") == F.col("_anc"))).groupBy("_d", "_n").agg(F.max_by("_value", "_depth").alias("_found"))
    out = el.join(found, (F.col(doc) == F.col("_d")) & (F.col("node_id") == F.col("_n")), "left")
    return out.select(*[c for c in el.columns if c != value], (F.coalesce("_found", default) if default is not None else F.col("_found")).alias(value))


def value_in_force(rows: DataFrame, *, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last value set at or before each row of its document."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def scoped_value(el: DataFrame, *, key: str, target: str | None = None) -> DataFrame:
    """``el``'s elements with ``value`` of the setting ``key`` that holds there, null where none does.

    Settings are processing instructions (``target``: of this name only). One holds for the element that it stands in, and from there to the end of
    that element for all that follows. The first directly inside an element wins, then the nearest before it among its siblings, then before
    its parent, and so on up. What holds beside each node is a window over siblings; the nearest ancestor that has such a value
    is one join, with a row for each step, whatever the number of settings. Each side is dealt by document once, its windows, joins and groups stay there.
    """
    is_pi = F.col("kind") == "pi"
    said = F.when(is_pi & (F.lit(True) if target is None else F.col("tag") == target), parse_pi(F.coalesce("text", F.lit("")))[key])
    before = F.last("said", ignorenulls=True).over(W.partitionBy("doc_id", "parent_id").orderBy("sib_pos").rowsBetween(W.unboundedPreceding, -1))
    set_ = dealt(el.filter(is_pi).select("doc_id", F.col("parent_id").alias("node_id"), "sib_pos", said.alias("said")).filter("said IS NOT NULL"))
    inside = set_.groupBy("doc_id", "node_id").agg(F.min_by("said", "sib_pos").alias("inside"))
    rows = dealt(el.select("doc_id", "node_id", "parent_id", "sib_pos", "depth", "kind", said.alias("said"))).withColumn("beside", before)
    steps = rows.filter("kind = 'element' AND beside IS NOT NULL").select("doc_id", F.col("node_id").alias("step"), "depth", "beside")
    own = dealt(el.filter("kind = 'element'"))
    up = own.select("doc_id", "node_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("step"))
    nearest = up.join(steps, ["doc_id", "step"]).groupBy("doc_id", "node_id").agg(F.max_by("beside", "depth").alias("outside"))
    out = own.join(inside, ["doc_id", "node_id"], "left").join(nearest, ["doc_id", "node_id"], "left")
    return out.withColumn("value", F.coalesce("inside", "outside")).drop("inside", "outside")


def select_boilerplate(docs: DataFrame, rules: DataFrame, *, on: list[str], fill: dict[str, Column]) -> DataFrame:
    """``docs`` with the notice that ``rules`` (the keys ``on``, text) give, "{name}" replaced by each value of ``fill``."""
    out = docs.join(F.broadcast(rules), on, "left")  # a fixed table of notices
    text = F.col("text")
    for name, c in fill.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out.withColumn("text", text)


def effective_dated(docs: DataFrame, versions: DataFrame, *, date: str) -> DataFrame:
    """``docs`` with the ``version`` in force at ``date``, from ``versions`` (since, until, version) with [since, until); null before the first."""
    v = F.broadcast(versions.select("since", "until", "version"))  # a few rows
    hit = (F.col(date) >= F.col("since")) & (F.col("until").isNull() | (F.col(date) < F.col("until")))
    return docs.join(v, hit, "left").drop("since", "until")


def character(code: Column) -> Column:
    """The character of a code point, of any plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def script_ranges(spark: SparkSession, scripts: Iterable[str], upto: int = 0x110000) -> DataFrame:
    """``lo``, ``hi``, ``script``: the runs of code points below ``upto`` that are of each script, by the properties of Unicode that expressions know."""
    codes = spark.range(upto).filter("NOT id BETWEEN 55296 AND 57343").withColumn("c", character(F.col("id")))
    of = codes.select(F.col("id").alias("code"), F.coalesce(*[F.when(F.col("c").rlike(rf"\p{{Is{s}}}"), s) for s in scripts]).alias("script")).filter("script IS NOT NULL")
    run = of.withColumn("run", F.col("code") - F.row_number().over(W.partitionBy("script").orderBy("code")))
    return run.groupBy("script", "run").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).select("lo", "hi", "script")


def script_of_codepoints(docs: DataFrame, ranges: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 128) -> DataFrame:
    """``id``, ``char``, ``script`` for each different character of a text; "Unknown" outside all ``ranges`` (lo, hi, script).

    Characters are made distinct in each text, and once more in the corpus: only those, a million at the very most, look for their range.
    Ranges are cut at blocks of code points, so that the look-up is an equi join on the block, whatever their number.
    """
    chars = docs.select(F.col(id_col), F.explode(F.array_distinct(F.split(text_col, ""))).alias("char")).filter(F.col("char") != "")
    cut = ranges.select("lo", "hi", "script", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("block"))
    code = F.ascii("char")
    each = chars.select("char").distinct().withColumn("block", F.floor(code / block))
    known = each.join(cut, "block").filter(code.between(F.col("lo"), F.col("hi"))).select("char", "script")
    return chars.join(known, "char", "left").select(id_col, "char", F.coalesce("script", F.lit("Unknown")).alias("script"))


def country_lookup(rows: DataFrame, countries: DataFrame, aliases: DataFrame, *, name: str) -> DataFrame:
    """``rows`` with ``code``: the name's alias if it has one, then the country of that code or name, in any case; null where none is."""
    key = lambda c: F.upper(F.btrim(c))
    a = F.broadcast(aliases.select(key(F.col("alias")).alias("_alias"), F.col("name").alias("_full")))
    c = F.broadcast(countries.select("code", F.explode(F.array_distinct(F.array(key(F.col("code")), key(F.col("name"))))).alias("_key")))
    out = rows.join(a, key(F.col(name)) == F.col("_alias"), "left").withColumn("_k", key(F.coalesce(F.col("_full"), F.col(name))))
    return out.join(c, F.col("_k") == F.col("_key"), "left").select(*rows.columns, "code")


def relation_edges(docs: DataFrame, relations: dict[str, str], *, doc: str) -> DataFrame:
    """``doc``, ``relation``, ``target`` from columns of comma-separated targets (column to relation); blanks are dropped."""
    parts = [docs.select(F.col(doc), F.lit(rel).alias("relation"), F.explode(F.split(col, ",")).alias("target")) for col, rel in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("target", F.btrim("target")).filter(F.col("target") != "")


def reverse_relations(edges: DataFrame, *, doc: str) -> DataFrame:
    """``target``, ``relation``, ``sources``: who obsoletes or updates a document, sorted."""
    return edges.groupBy("target", "relation").agg(F.array_sort(F.collect_set(doc)).alias("sources"))
