"""Numbering, order checks and sorts within documents. Every window is partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.jobs.folders import dealt, written


def hierarchical_numbers(nodes: DataFrame, *, doc: str, node: str, path: str, part: str, sib: str, parent: str) -> DataFrame:
    """``nodes`` with ``number``: "1.4.2", and "a.1" for parts other than the first, whose top level counts in letters.

    ``path`` holds the ids from the topmost numbered ancestor down to the node itself. A node's rank among its siblings is
    one window; the ranks along the path are joined once. More than 26 letters give null.
    """
    rank = F.row_number().over(W.partitionBy(doc, part, parent).orderBy(sib))
    ranks = nodes.select(F.col(doc).alias("_d"), F.col(node).alias("_n"), rank.alias("_r"))
    steps = nodes.select(doc, node, F.posexplode(path).alias("_at", "_step"))
    along = steps.join(ranks, (F.col(doc) == F.col("_d")) & (F.col("_step") == F.col("_n"))).groupBy(doc, node).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_r"))), lambda x: x["_r"]).alias("_ranks"))
    out = nodes.join(along, [doc, node])
    return out.withColumn("number", number_of(F.col("_ranks"), F.col(part) == "back")).drop("_ranks")


def number_of(ranks: Column, letters: Column) -> Column:
    """"1.4.2" of the ranks along a path; where ``letters`` holds, the first is a letter ("a.1"), and more than 26 give null."""
    plain = F.array_join(ranks.cast("array<string>"), ".")
    first = F.get(ranks, F.lit(0))
    rest = F.when(F.size(ranks) > 1, F.concat(F.lit("."), F.array_join(F.slice(ranks, 2, F.size(ranks)).cast("array<string>"), "."))).otherwise("")
    return F.when(letters, F.when(first <= 26, F.concat(F.chr(F.lit(96) + first), rest))).otherwise(plain)


def flat_numbers(rows: DataFrame, *, doc: str, kind: str, pos: str, prefix: Column | None = None) -> DataFrame:
    """``rows`` with ``pn``: a counter for each document and kind."""
    n = F.row_number().over(W.partitionBy(doc, kind).orderBy(pos))
    return rows.withColumn("pn", F.concat_ws("-", prefix if prefix is not None else F.col(kind), n))


def paragraph_numbers(rows: DataFrame, *, by: list[str], pos: str, counts: Column, numbered: Column) -> DataFrame:
    """``rows`` with ``para``: the number among blocks that count; null for those that get no number of their own."""
    n = F.sum(counts.cast("int")).over(W.partitionBy(*by).orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("para", F.when(numbered, n))


#: What counts among the blocks of a section, what counts without a number of its own, where numbers begin anew, and what has none inside: fixed values.
PARAGRAPHS = ("artset", "artwork", "aside", "blockquote", "list", "dl", "dd", "ol", "ul", "dt", "li", "sourcecode", "t", "figure", "table")
COUNTED_ONLY = ("thead", "tbody", "tfoot", "tr", "td")
NUMBERED_APART = ("figure", "table")
BEGIN_ANEW = ("abstract", "note", "section", "references")
NO_NUMBERS = ("reference",)


def nested_paragraph_numbers(el: DataFrame, pns: DataFrame) -> DataFrame:
    """``doc_id``, ``node_id``, ``tag``, ``pn`` of every block: its section's pn, a hyphen, and the path of its numbers, "section-9.1-2.1".

    ``el`` is a table of elements, ``pns`` (doc_id, node_id, pn) the numbers of sections and the like; one that has none is
    "unknown-unknown". Each element's place in its parent is a running count of those that count, up to itself, and a path
    is the places from below the nearest section down: one window, and one join with those ancestors of blocks that lie between. Figures and tables count
    but are numbered elsewhere; inside a reference nothing is. A number that an element has already wins.
    """
    counts = F.col("tag").isin(*PARAGRAPHS, *COUNTED_ONLY)
    place = F.coalesce(F.sum(counts.cast("int")).over(W.partitionBy("doc_id", "parent_id").orderBy("sib_pos").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = el.filter("kind = 'element'")
    # where the nearest section above is among the ancestors, from 1; 0: there is none
    at = F.size("anc_tags") - F.coalesce(F.array_position(F.reverse(F.transform("anc_tags", lambda t: t.isin(*BEGIN_ANEW))), True), F.lit(0)).cast("int") + 1
    at = F.when(F.exists("anc_tags", lambda t: t.isin(*BEGIN_ANEW)), at).otherwise(0)
    block = F.col("tag").isin(*PARAGRAPHS) & ~F.col("tag").isin(*NUMBERED_APART) & ~F.exists("anc_tags", lambda t: t.isin(*NO_NUMBERS))
    told = F.when(block & (F.col("at") > 0), F.struct(F.get("anc_ids", F.col("at") - 1).alias("top"), F.slice("anc_ids", F.col("at") + 1, F.size("anc_ids")).alias("between"), F.col("attrs")["pn"].alias("own")))
    rows = rows.withColumn("at", at).select("doc_id", "node_id", "parent_id", "sib_pos", "tag", "depth", told.alias("b"))
    rows = dealt(rows).select("doc_id", "node_id", "tag", "depth", "b", place.alias("place"))
    blocks = rows.filter("b IS NOT NULL").select("doc_id", "node_id", "tag", "place", "b.*")
    steps = rows.select("doc_id", F.col("node_id").alias("step"), F.struct("depth", "place").alias("s"))
    path = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["place"].cast("string"))
    above = blocks.select("doc_id", "node_id", F.explode("between").alias("step")).join(steps, ["doc_id", "step"]).groupBy("doc_id", "node_id").agg(path.alias("above"))
    pns = dealt(pns.select("doc_id", F.col("node_id").alias("top"), F.col("pn").alias("top_pn")))
    out = blocks.join(above, ["doc_id", "node_id"], "left").join(pns, ["doc_id", "top"], "left")
    numbers = F.concat_ws(".", "above", F.col("place").cast("string"))
    return out.select("doc_id", "node_id", "tag", F.coalesce("own", F.concat(F.coalesce("top_pn", F.lit("unknown-unknown")), F.lit("-"), numbers)).alias("pn"))


def list_counters(lists: DataFrame, *, doc: str, group: str, pos: str, start: str, n_items: str) -> DataFrame:
    """``lists`` with ``first``: lists of one group go on counting; an explicit start counts anew. Lists without a group start at 1."""
    w = W.partitionBy(doc, group).orderBy(pos)
    seg = F.sum(F.col(start).isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = lists.withColumn("_seg", seg)
    ws = W.partitionBy(doc, group, "_seg").orderBy(pos)
    before = F.coalesce(F.sum(n_items).over(ws.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.coalesce(F.first(start).over(ws.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(1))
    return out.withColumn("first", F.when(F.col(group).isNull(), F.coalesce(start, F.lit(1))).otherwise(base + before).cast("long")).drop("_seg")


def unique_slugs_fast(names: DataFrame, *, doc: str, pos: str, slug: Column, size: int = 32) -> DataFrame:
    """Slugs cut to ``size`` and made unique by "-2", "-3": one window. The exact form, which grows slugs first, is :func:`unique_slugs`."""
    short = names.withColumn("_s", F.substring(slug, 1, size))
    n = F.row_number().over(W.partitionBy(doc, "_s").orderBy(pos))
    return short.withColumn("slug", F.when(n == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", n))).drop("_s")


def unique_slugs(names: DataFrame, *, doc: str, pos: str, slug: Column, short: int = 32, long: int = 40, most: int = 99) -> DataFrame:
    """``doc``, ``pos``, ``slug``: unique slugs, each the first free one of its list, earlier names first; null beyond ``most``.

    A name's list is its slug cut to ``short``, ``short`` + 1, ... ``long`` characters, then the longest of these with "-2", "-3" ...
    The rule goes name by name, but needs no such order: every name claims the first slug of its list, the earliest claimant
    holds it, the others claim the next of theirs, until none has to. What is held may be lost to an earlier name that comes to it later, so
    this ends where going name by name ends. Names with one list step past each other at once, so that equal names need one
    round, not as many as there are. Each round is a window over claims; no task holds a document.
    """
    sizes = F.greatest(F.lit(short), F.least(F.lit(long), F.length("s"))) - short + 1
    number = F.col("at") - sizes + 2
    claim = F.when(F.col("at") < sizes, F.substr("s", F.lit(1), (short + F.col("at")).cast("int"))).when(number <= most, F.concat(F.substr("s", F.lit(1), (short + sizes - 1).cast("int")), F.lit("-"), number))
    rows = names.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.substr(F.coalesce(slug, F.lit("")), F.lit(1), F.lit(long)).alias("s"), F.lit(0).alias("at"))
    while True:
        claims = W.partitionBy("doc", "claim").orderBy("pos")
        step = rows.withColumn("claim", claim).withColumn("rank", F.row_number().over(claims)).withColumn("same", F.row_number().over(W.partitionBy("doc", "claim", "s", "at").orderBy("pos")))
        first = F.max(F.col("rank") == 1).over(W.partitionBy("doc", "claim", "s", "at"))  # whether the holder is one of these
        moves = F.when(F.col("claim").isNull() | (F.col("rank") == 1), 0).otherwise(F.col("same") - F.when(first, 1).otherwise(0))
        rows = written(step.select("doc", "pos", "s", "at", "claim", moves.alias("moves")))
        if rows.filter("moves > 0").isEmpty():
            return rows.select(F.col("doc").alias(doc), F.col("pos").alias(pos), F.col("claim").alias("slug"))
        rows = rows.select("doc", "pos", "s", (F.col("at") + F.col("moves")).alias("at"))


def unnumbered_order(sections: DataFrame, *, doc: str, parent: str, pos: str, numbered: str) -> DataFrame:
    """Numbered sections after an unnumbered sibling."""
    before = F.max((~F.col(numbered)).cast("int")).over(W.partitionBy(doc, parent).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    return sections.withColumn("_b", before).filter((F.col("_b") == 1) & F.col(numbered)).drop("_b")


def unnumbered_parents(sections: DataFrame, *, doc: str, node: str, parent: str, numbered: str) -> DataFrame:
    """Numbered sections right below an unnumbered one. Only ids of unnumbered sections are joined."""
    plain = sections.filter(~F.col(numbered)).select(F.col(doc).alias("_d"), F.col(node).alias("_n")).distinct()
    return sections.filter(F.col(numbered)).join(plain, (F.col(doc) == F.col("_d")) & (F.col(parent) == F.col("_n")), "left_semi")


def keep_with_previous(rows: DataFrame, *, by: list[str], pos: str, flag: Column) -> DataFrame:
    """``rows`` with ``keep_with_next``: whether the next sibling asks to be kept with this one."""
    return rows.withColumn("keep_with_next", F.coalesce(F.lead(flag).over(W.partitionBy(*by).orderBy(pos)), F.lit(False)))


def first_child_is(children: DataFrame, *, by: list[str], pos: str, test: Column, ignore: Column) -> DataFrame:
    """``by``, ``holds``: whether the first child that isn't ignored meets ``test``."""
    return children.filter(~ignore).groupBy(*by).agg(F.min_by(test, pos).alias("holds"))


def toc_visibility(sections: DataFrame, *, doc: str, node: str, path: str, mark: str, depth: int = 3) -> DataFrame:
    """``sections`` with ``visible``. ``mark`` is include, exclude or null; ``path`` the ids from the top down to the node.

    Shown: what is marked so, or holds a section that is; else not below one that is excluded; else down to ``depth``.
    """
    marked = sections.filter(F.col(mark).isNotNull()).select(F.col(doc).alias("_d"), F.col(node).alias("_n"), F.col(mark).alias("_m"), F.col(path).alias("_p"))
    above = marked.filter("_m = 'include'").select("_d", F.explode("_p").alias("_n")).distinct().withColumn("_inc", F.lit(True))
    out = sections.join(above, (F.col(doc) == F.col("_d")) & (F.col(node) == F.col("_n")), "left").drop("_d", "_n")
    steps = sections.select(F.col(doc).alias("_d2"), F.col(node).alias("_n2"), F.explode(path).alias("_step"))
    hidden = steps.join(marked.filter("_m = 'exclude'"), (F.col("_d2") == F.col("_d")) & (F.col("_step") == F.col("_n"))).select("_d2", "_n2").distinct().withColumn("_exc", F.lit(True))
    out = out.join(hidden, (F.col(doc) == F.col("_d2")) & (F.col(node) == F.col("_n2")), "left").drop("_d2", "_n2")
    visible = F.when(F.col("_inc").isNotNull(), True).when(F.col("_exc").isNotNull(), False).otherwise(F.size(path) <= depth)
    return out.withColumn("visible", visible).drop("_inc", "_exc")


def shown(sections: DataFrame, *, doc: str, node: str, last: str, level: Column, mark: str, depth: int = 3) -> DataFrame:
    """The same ``visible`` from places in the document instead of paths: ``node`` in document order, ``last`` the last node below it, ``level`` from 1.

    What began before a node and has not ended is above it, what begins up to its last node is below: two windows, no joins.
    """
    before = F.max(F.when(F.col(mark) == "exclude", F.col(last))).over(W.partitionBy(doc).orderBy(node).rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(F.col(mark) == "include", F.col(node))).over(W.partitionBy(doc).orderBy(F.col(node).desc()).rowsBetween(W.unboundedPreceding, 0))
    out = sections.withColumn("_hidden", F.coalesce(before >= F.col(node), F.lit(False))).withColumn("_held", F.coalesce(after <= F.col(last), F.lit(False)))
    return out.withColumn("visible", is_shown(F.col("_held"), F.col("_hidden"), level <= depth)).drop("_held", "_hidden")


def is_shown(held: Column, hidden: Column, high: Column) -> Column:
    """Whether a section is shown that holds one marked so, is hidden with one above, or stands high enough."""
    return F.when(held, True).when(hidden, False).otherwise(high)


def index_numbers(entries: DataFrame, *, doc: str, pos: str, item: str, sub: str, slug) -> DataFrame:
    """``entries`` with ``pn``: "iref-item-sub-n", unique in the document."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(pos))
    return entries.withColumn("pn", F.concat_ws("-", F.lit("iref"), slug(F.concat_ws("-", item, F.when(F.col(sub) != "", F.col(sub)))), n))


def plain_pages(lines: DataFrame, *, doc: str, pos: str, height: int = 48) -> DataFrame:
    """``lines`` with ``page`` of a fixed height. Blocks, widows and orphans are kept together in ``helpers.assign_pages``."""
    return lines.withColumn("page", F.floor((F.row_number().over(W.partitionBy(doc).orderBy(pos)) - 1) / height) + 1)


def sort_references(refs: DataFrame, *, doc: str, name: Column, pos: str, sort: bool = True) -> DataFrame:
    """``refs`` with ``rank``: by upper-cased display name, then in input order; in input order only where not sorted."""
    return refs.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy(*([F.upper(name)] if sort else []), pos)))


#: Series that come first, in this order: fixed values.
SERIES_ORDER = ("STD", "BCP", "FYI", "RFC", "DOI")


def sort_series(rows: DataFrame, *, by: list[str], name: str, pos: str, order: tuple[str, ...] = SERIES_ORDER) -> DataFrame:
    """``rows`` with ``rank``: known series first in their order, then the rest in input order."""
    known = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.when(known > 0, known).otherwise(len(order) + 1), pos)))


def pick_target(rows: DataFrame, *, by: list[str], name: str, value: str, pos: str, base: dict[str, str]) -> DataFrame:
    """``by``, ``target``: the URL from the first series in order that has a base."""
    urls = F.create_map(*[F.lit(x) for p in base.items() for x in p])
    hit = rows.filter(F.col(name).isin(*base))
    return hit.groupBy(*by).agg(F.min_by(F.concat(urls[F.col(name)], F.col(value)), pos).alias("target"))


def table_of_contents(sections: DataFrame, *, doc: str, pos: Column, number: str, title: str, level: Column, appendix: Column, page: Column) -> DataFrame:
    """``doc``, ``rank``, ``line`` of visible sections: indented by level, "Appendix A" for appendices, the page at the end."""
    label = F.when(appendix, F.concat(F.lit("Appendix "), F.upper(F.col(number)), F.lit(". "))).otherwise(F.concat(F.col(number), F.lit(". ")))
    line = F.concat(F.repeat(F.lit("  "), level - 1), label, F.col(title), F.lit(" "), page.cast("string"))
    shown = sections.filter("visible")
    return shown.select(doc, F.row_number().over(W.partitionBy(doc).orderBy(pos)).alias("rank"), line.alias("line"))


def pick_artset_anchor(art: DataFrame, *, by: str, anchor: str) -> DataFrame:
    """``by``, ``anchor`` (the smallest) and ``dropped`` (the others, sorted)."""
    g = art.filter(F.col(anchor).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(anchor)).alias("_a"))
    return g.select(by, F.get("_a", F.lit(0)).alias("anchor"), F.slice("_a", 2, F.size("_a")).alias("dropped"))


def cells_from_flat(cells: DataFrame, *, table: str, pos: str, n_cols: Column, aligns: str | None = None) -> DataFrame:
    """``cells`` with ``row`` and ``col``: the n-th goes to row n / columns; ``align`` copied from the header's list."""
    n = F.row_number().over(W.partitionBy(table).orderBy(pos)) - 1
    out = cells.withColumn("_n", n).withColumns({"row": F.floor(F.col("_n") / n_cols), "col": F.pmod(F.col("_n"), n_cols)})
    return (out if aligns is None else out.withColumn("align", F.get(F.col(aligns), F.col("col").cast("int")))).drop("_n")


def uniq_first(df: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def tag_sets(vocab: DataFrame, block: DataFrame, text: DataFrame) -> DataFrame:
    """``set``, ``tag``: block and text tags, those that are inline (in the vocabulary and no block), and text blocks (both)."""
    name = lambda df, s: df.select(F.lit(s).alias("set"), "tag")
    v, b, t = vocab.select("tag"), block.select("tag"), text.select("tag")
    return name(b, "block").unionByName(name(t, "text")).unionByName(name(v.exceptAll(b), "inline")).unionByName(name(b.intersect(t), "text_block"))


def compare_corpora(old: DataFrame, new: DataFrame, *, key: str, line: str, ignore: str | None = None) -> DataFrame:
    """Lines that only one side has, with ``side`` and ``n`` of them, counted as often as they occur; ``ignore`` is a pattern of lines that don't count.

    Both sides are counted with opposite signs in one aggregation, which combines before it shuffles.
    """
    both = old.select(key, line, F.lit(-1).alias("_s")).unionByName(new.select(key, line, F.lit(1).alias("_s")))
    if ignore:
        both = both.filter(~F.col(line).rlike(ignore))
    d = both.groupBy(key, line).agg(F.sum("_s").alias("_d")).filter("_d <> 0")
    return d.select(key, line, F.when(F.col("_d") > 0, "new").otherwise("old").alias("side"), F.abs("_d").alias("n"))
