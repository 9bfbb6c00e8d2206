"""Selections and rewrites of elements. Functions take and return DataFrames; column names are parameters."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import is_ascii, is_script
from quire.jobs.folders import dealt


def select_elements(el: DataFrame, *, tag: Iterable[str] | None = None, has_attr: str | None = None, attr_eq: tuple[str, str] | None = None, under: DataFrame | None = None, tag_col: str = "tag", attrs_col: str = "attrs") -> DataFrame:
    """Elements by tag, by an attribute or its value, and below any of the elements ``under`` (doc_id, node_id)."""
    if tag is not None:
        el = el.filter(F.col(tag_col).isin(*tag))
    if has_attr is not None:
        el = el.filter(F.map_contains_key(F.col(attrs_col), has_attr))
    if attr_eq is not None:
        el = el.filter(F.col(attrs_col)[attr_eq[0]] == attr_eq[1])
    if under is not None:
        top = under.select("doc_id", F.col("node_id").alias("_top")).distinct()
        below = el.select("doc_id", "node_id", F.explode("anc_ids").alias("_top")).join(top, ["doc_id", "_top"], "left_semi")
        el = el.join(below.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    return el


def remove_subtrees(el: DataFrame, condition: Column) -> DataFrame:
    """Elements without those that meet ``condition`` and what is below them; a removed element's tail joins what stands before it.

    The tail goes to the nearest kept sibling before it, or else to the parent's text.
    Rows are dealt by document once, and all is windows within that: an element goes if one that is removed began before it and has not ended.
    """
    own, siblings = W.partitionBy("doc_id").orderBy("node_id"), W.partitionBy("doc_id", "parent_id").orderBy("sib_pos")
    hit, before = F.coalesce(condition, F.lit(False)), (W.unboundedPreceding, -1)
    rows = el.repartition("doc_id").withColumn("_hit", hit)
    rows = rows.withColumn("_below", F.coalesce(F.max(F.when(F.col("_hit"), F.col("last_desc"))).over(own.rowsBetween(*before)) >= F.col("node_id"), F.lit(False)))
    rows = rows.withColumn("_near", F.last(F.when(~F.col("_hit") & ~F.col("_below"), F.col("node_id")), ignorenulls=True).over(siblings.rowsBetween(*before)))
    moves = F.col("_hit") & ~F.col("_below") & F.col("tail").isNotNull()
    # a tail meets the row that it moves to in one window
    rows = rows.withColumn("_moves", moves).withColumn("_home", F.when(moves, F.coalesce("_near", "parent_id")).otherwise(F.col("node_id")))
    home = W.partitionBy("doc_id", "_home")
    joined = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("sib_pos", "tail"))).over(home)), lambda x: x["tail"]), "")
    rows = rows.withColumns({"_tail": joined(F.col("_moves") & F.col("_near").isNotNull()), "_text": joined(F.col("_moves") & F.col("_near").isNull())})
    add = lambda c, more: F.when(F.col(more) == "", F.col(c)).otherwise(F.concat(F.coalesce(F.col(c), F.lit("")), F.col(more)))
    return rows.filter("NOT _hit AND NOT _below").withColumns({"tail": add("tail", "_tail"), "text": add("text", "_text")}).select(*el.columns)


def remove_marked(tokens: DataFrame, tags: Iterable[str], *, doc_col: str = "page_id", pos_col: str = "pos") -> DataFrame:
    """The same for flat tokens: those between a tag's opening and its closing go, and the two themselves."""
    hit = F.col("tag").isin(*tags)
    step = F.when(hit & ~F.col("is_close"), 1).when(hit & F.col("is_close"), -1).otherwise(0)
    depth = F.sum(step).over(W.partitionBy(doc_col).orderBy(pos_col))
    return tokens.withColumn("_depth", depth).filter((F.col("_depth") <= 0) & ~hit).drop("_depth")


def fill_attr_defaults(el: DataFrame, defaults: DataFrame, *, tag_col: str = "tag", attrs_col: str = "attrs", skip: Column | None = None) -> DataFrame:
    """Attributes that an element lacks, from ``defaults`` (tag, defaults MAP); rows that meet ``skip`` stay as they are."""
    d = F.broadcast(defaults.select(F.col("tag").alias("_tag"), F.col("defaults").alias("_d")))  # one row a tag of a fixed vocabulary
    missing = F.map_filter("_d", lambda k, v: ~F.map_contains_key(F.col(attrs_col), k))
    filled = F.when(F.col("_d").isNull() | (skip if skip is not None else F.lit(False)), F.col(attrs_col)).otherwise(F.map_concat(F.col(attrs_col), missing))
    return el.join(d, F.col(tag_col) == F.col("_tag"), "left").withColumn(attrs_col, filled).select(*el.columns)


def strip_attr_defaults(el: DataFrame, defaults: DataFrame, *, tag_col: str = "tag", attrs_col: str = "attrs") -> DataFrame:
    """The inverse: attributes go that equal the default."""
    d = F.broadcast(defaults.select(F.col("tag").alias("_tag"), F.col("defaults").alias("_d")))
    kept = F.map_filter(attrs_col, lambda k, v: F.coalesce(F.col("_d")[k] != v, F.lit(True)))
    return el.join(d, F.col(tag_col) == F.col("_tag"), "left").withColumn(attrs_col, F.when(F.col("_d").isNull(), F.col(attrs_col)).otherwise(kept)).select(*el.columns)


#: Attributes and elements that preparation derives from others.
DERIVED_ATTRS = ("pn", "slugifiedName", "derivedContent", "derivedLink", "derivedAnchor", "derivedCounter")
DERIVED_TAGS = ("toc", "boilerplate")


def unprep(el: DataFrame) -> DataFrame:
    """Elements without what preparation derived: attributes, the table of contents and the standard notices."""
    el = remove_subtrees(el, F.coalesce(F.col("tag").isin(*DERIVED_TAGS), F.lit(False)))
    return el.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.isin(*DERIVED_ATTRS)))


def yes_no_to_bool(el: DataFrame, *, attrs_col: str = "attrs") -> DataFrame:
    """Attribute values yes and no as true and false."""
    values = F.transform_values(attrs_col, lambda k, v: F.when(v == "yes", "true").when(v == "no", "false").otherwise(v))
    return el.withColumn(attrs_col, F.when(F.size(attrs_col) > 0, values).otherwise(F.col(attrs_col)))


def clean_attrs(el: DataFrame, *, rename: dict[str, str], keep_space: Iterable[str] = (), attrs_col: str = "attrs") -> DataFrame:
    """Attributes renamed, their values trimmed but for those of ``keep_space`` (named as before)."""
    keep = list(keep_space)
    values = F.transform_values(attrs_col, lambda k, v: F.when(k.isin(*keep), v).otherwise(F.trim(v)) if keep else F.trim(v))
    if not rename:
        return el.withColumn(attrs_col, F.when(F.size(attrs_col) > 0, values).otherwise(F.col(attrs_col)))
    names = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
    return el.withColumn(attrs_col, F.transform_keys(values, lambda k, v: F.coalesce(names[k], k)))


def check_typed_attrs(el: DataFrame, spec: dict[str, str | None], *, attrs_col: str = "attrs") -> DataFrame:
    """A row (element's columns, ``attr``, ``value``) for each integer attribute of ``spec`` that isn't digits nor its default there."""
    tests = [F.struct(F.lit(a).alias("attr"), F.col(attrs_col)[a].alias("value"), F.lit(d).cast("string").alias("default")) for a, d in spec.items()]
    rows = el.select("*", F.explode(F.array(*tests)).alias("_t")).filter(is_no_integer(F.col("_t.value"), F.col("_t.default")))
    return rows.select(*el.columns, "_t.attr", "_t.value")


def is_no_integer(value: Column, default: Column) -> Column:
    """Whether a value is there and neither digits nor the default."""
    return value.isNotNull() & ~value.rlike("^[0-9]+$") & ~value.eqNullSafe(default)


def rename_tags(el: DataFrame, mapping: DataFrame, *, tag_col: str = "tag", style: Column | None = None) -> DataFrame:
    """Tags renamed by ``mapping`` (tag, style, new_tag); a null style there holds for every style that has no row of its own."""
    m = mapping.select(F.col("tag").alias("_tag"), F.col("style").alias("_style"), F.col("new_tag").alias("_new"))
    s = style if style is not None else F.lit(None).cast("string")
    exact = F.broadcast(m.filter("_style IS NOT NULL"))
    loose = F.broadcast(m.filter("_style IS NULL").select(F.col("_tag").alias("_tag2"), F.col("_new").alias("_new2")))
    out = el.withColumn("_s", s).join(exact, (F.col(tag_col) == F.col("_tag")) & (F.col("_s") == F.col("_style")), "left").join(loose, F.col(tag_col) == F.col("_tag2"), "left")
    return out.withColumn(tag_col, F.coalesce("_new", "_new2", tag_col)).select(*el.columns)


#: How a list of each style is written: its tag and the type of its numbers. Fixed values; other styles are plain lists.
LIST_STYLES = {"empty": ("ul", None), "symbols": ("ul", None), "hanging": ("dl", None), "numbers": ("ol", "1"), "inherit": ("ol", "1"), "letters": ("ol", "a")}


def convert_lists(el: DataFrame) -> DataFrame:
    """``list`` elements as ``ul``, ``ol`` or ``dl`` by their style; one without a style takes that of the nearest list around it.

    ``format x`` gives an ``ol`` of type x. Letters and roman numerals change case with each list that inherits them. Without any style
    around it the outermost list is an empty ``ul`` and those in it are plain. ``style`` and ``counter`` go; an ``ol`` has its counter as ``group``.
    Only lists are joined with the lists around them: a row for each list around one, then one array of that length. Lists are dealt by document, once for each side.
    """
    style = F.when(F.col("tag") == "list", F.trim(F.coalesce(F.col("attrs")["style"], F.lit(""))))
    lists = el.filter(F.col("tag").isin("list", "ul", "ol", "dl")).withColumn("style", style)
    tags = F.coalesce(*[F.when(F.col("style") == s, t) for s, (t, _) in LIST_STYLES.items()], F.when(F.col("style").startswith("format"), "ol"), F.when(F.col("tag") == "list", "ul"), F.col("tag"))
    types = F.coalesce(*[F.when(F.col("style") == s, n) for s, (_, n) in LIST_STYLES.items() if n], F.when(F.col("style").startswith("format"), F.substr("style", F.lit(8))), F.when(F.col("tag") == "ol", F.coalesce(F.col("attrs")["type"], F.lit("1"))))
    says = F.when(F.col("style").isNull() | (F.col("style") != ""), F.struct(tags.alias("tag"), types.alias("type")))
    lists = dealt(lists.withColumn("says", says).select("doc_id", "node_id", "depth", "tag", "style", "says", F.filter("anc_ids", lambda x, i: F.get("anc_tags", i).isin("list", "ul", "ol", "dl")).alias("up")))
    around = lists.select("doc_id", F.col("node_id").alias("step"), F.struct("depth", "says").alias("around"))
    open_ = lists.filter("says IS NULL").select("doc_id", "node_id", F.explode("up").alias("step"))
    found = open_.join(around, ["doc_id", "step"]).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list("around")).alias("around"))
    said = F.filter("around", lambda x: x["says"].isNotNull())
    last = F.get(said, F.size(said) - 1)
    steps = F.size(F.filter("around", lambda x: x["depth"] > last["depth"])) + 1
    turned = F.when(last["says"]["type"].isin("a", "A", "i", "I") & (steps % 2 == 1), F.translate(last["says"]["type"], "aAiI", "AaIi")).otherwise(last["says"]["type"])
    found = found.select("doc_id", "node_id", F.coalesce(last["says"]["tag"], F.lit("ul")).alias("_tag"), turned.alias("_type"))
    own = lists.filter("tag = 'list'").select("doc_id", "node_id", "says", (F.col("style") == "empty").alias("_empty")).join(found, ["doc_id", "node_id"], "left")
    own = own.select("doc_id", "node_id", F.coalesce("says.tag", "_tag", F.lit("ul")).alias("_new"), F.coalesce("says.type", "_type").alias("_type"), (F.col("_empty") | (F.col("says").isNull() & F.col("_tag").isNull())).alias("_empty"))
    out = dealt(el).join(own, ["doc_id", "node_id"], "left")
    more = F.array(
        F.when(F.col("_new") == "ol", F.struct(F.lit("type").alias("k"), F.col("_type").alias("v"))), F.when(F.col("_empty"), F.struct(F.lit("empty").alias("k"), F.lit("true").alias("v"))),
        F.when(F.col("_new") == "dl", F.struct(F.lit("newline").alias("k"), F.lit("false").alias("v"))), F.when((F.col("_new") == "ol") & F.col("attrs")["counter"].isNotNull(), F.struct(F.lit("group").alias("k"), F.col("attrs")["counter"].alias("v"))),
    )
    kept = F.map_filter("attrs", lambda k, v: ~k.isin("style", "counter", "type", "empty", "newline", "group"))
    attrs = F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(F.map_concat(kept, F.map_from_entries(F.array_compact(more))))
    return out.withColumns({"attrs": attrs, "tag": F.coalesce("_new", "tag")}).select(*el.columns)


def vocabulary_findings(el: DataFrame, vocab: DataFrame, deprecated: DataFrame, *, tag_col: str = "tag") -> DataFrame:
    """Rows of ``el`` with ``severity`` and ``code``: tags outside ``vocab`` (tag), and tags in ``deprecated`` (tag)."""
    known, old = (F.broadcast(x.select(F.col("tag").alias("_tag"))) for x in (vocab, deprecated))
    unknown = el.join(known, F.col(tag_col) == F.col("_tag"), "left_anti").select("*", F.lit("error").alias("severity"), F.lit("unknown-tag").alias("code"))
    dated = el.join(old, F.col(tag_col) == F.col("_tag"), "left_semi").select("*", F.lit("warning").alias("severity"), F.lit("deprecated-tag").alias("code"))
    return unknown.unionByName(dated)


def silence_findings(findings: DataFrame, patterns: Iterable[str], *, message_col: str = "message") -> DataFrame:
    """Findings whose message neither starts with a pattern nor matches one, as a regular expression, from its start.

    "Note: " and "Warning: " before a pattern don't count; what is no valid expression is compared as text only.
    """
    silent = F.lit(False)
    for p in patterns:
        p = re.sub(r"^(Note|Warning): ", "", p)
        silent = silent | F.col(message_col).startswith(p)
        try:
            re.compile(p)
        except re.error:
            continue
        silent = silent | F.col(message_col).rlike(f"^(?:{p})")
    return findings.filter(~F.coalesce(silent, F.lit(False)))


#: Prefixes that generated ids use.
RESERVED = ("section", "figure", "table", "iref", "u")


def reserved_prefix_findings(ids: DataFrame, *, id_col: str = "anchor", prefixes: Iterable[str] = RESERVED) -> DataFrame:
    """Rows whose id starts with a reserved prefix and a hyphen."""
    return ids.filter(is_reserved(F.col(id_col), prefixes))


def is_reserved(c: Column, prefixes: Iterable[str] = RESERVED) -> Column:
    """Whether an id starts with a reserved prefix and a hyphen."""
    return c.rlike(f"^({'|'.join(map(re.escape, prefixes))})-")


def pair_problem(full: Column, twin: Column) -> Column:
    """What is wrong with a value and its ASCII twin, or null: "redundant", "orphan" or "missing"."""
    lacks = full.isNotNull() & twin.isNull() & ~is_ascii(full) & ~is_script(full, "Latin")
    return F.when(full.isNotNull() & (full == twin), "redundant").when(full.isNull() & twin.isNotNull(), "orphan").when(lacks, "missing")


def redundant_pairs(el: DataFrame, pairs: dict[str, str], *, attrs_col: str = "attrs") -> tuple[DataFrame, DataFrame]:
    """(elements, findings) for attributes with an ASCII twin (original to twin).

    A twin that equals its original goes, with a warning; a twin without original, and an original not in Latin script
    without a twin, are errors. Findings are the element's columns, ``severity``, ``code``, ``attr``.
    """
    a = F.col(attrs_col)
    checks = []
    for full, twin in pairs.items():
        checks.append(F.struct(F.lit(twin).alias("attr"), pair_problem(a[full], a[twin]).alias("code")))
    rows = el.select("*", F.explode(F.array(*checks)).alias("_c")).filter("_c.code IS NOT NULL")
    found = rows.select(*el.columns, F.when(F.col("_c.code") == "redundant", "warning").otherwise("error").alias("severity"), F.col("_c.code").alias("code"), F.col("_c.attr").alias("attr"))
    drop = lambda k, v: F.lit(False)
    for full, twin in pairs.items():
        drop = lambda k, v, f=full, t=twin, before=drop: before(k, v) | ((k == t) & F.coalesce(a[f] == v, F.lit(False)))
    return el.withColumn(attrs_col, F.map_filter(attrs_col, lambda k, v: ~drop(k, v))), found
