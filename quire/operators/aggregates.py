"""Groupings: duplicates, indexes, page lists, table measures, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_ids(rows: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of the same id (``by``) in order, with ``nth``."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("nth > 1")


def build_index(entries: DataFrame, *, doc: str, item: str, sub: str, anchor: str, pos: str, primary: str) -> DataFrame:
    """Index lines: ``letter``, ``item``, ``sub``, ``anchors`` (in order, primary ones marked), ``rank`` in the document.

    Of each item and anchor the first entry counts, whatever its subitem. Letters that aren't alphanumeric come first;
    items and subitems are in order of their lower-cased text.
    """
    first = entries.groupBy(doc, item, anchor).agg(F.min(F.struct(pos, sub, primary)).alias("e")).select(doc, item, anchor, f"e.{pos}", f"e.{sub}", f"e.{primary}")
    letter = F.upper(F.substring(item, 1, 1))
    lines = first.groupBy(doc, letter.alias("letter"), F.col(item).alias("item"), F.coalesce(sub, F.lit("")).alias("sub"))
    lines = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, anchor, primary))), lambda x: F.concat(x[anchor], F.when(x[primary], "*").otherwise(""))).alias("anchors"))
    order = [F.col("letter").rlike(r"^[\p{L}\p{N}]"), "letter", F.lower("item"), "item", F.lower("sub"), "sub"]
    return lines.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy(*order)))


def page_ranges(hits: DataFrame, *, by: list[str], page: str) -> DataFrame:
    """``pages`` for each group: distinct pages, runs folded: "1-3, 5"."""
    d = hits.select(*by, F.col(page).cast("int").alias("p")).filter("p IS NOT NULL").distinct()
    runs = d.withColumn("g", F.col("p") - F.row_number().over(W.partitionBy(*by).orderBy("p"))).groupBy(*by, "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("pages"))


def table_dimensions(cells: DataFrame, *, table: str, row: str, colspan: str = "colspan", rowspan: str = "rowspan") -> DataFrame:
    """``n_rows``, ``n_cols``: columns by the widest row; rows and what the last row's greatest rowspan adds."""
    rows = cells.groupBy(table, row).agg(F.sum(colspan).alias("w"), F.max(rowspan).alias("h"))
    return rows.groupBy(table).agg((F.count("*") + F.max_by("h", row) - 1).cast("long").alias("n_rows"), F.max("w").cast("long").alias("n_cols"))


def column_min_widths(cells: DataFrame, *, table: str, col: str, text: str, colspan: str = "colspan") -> DataFrame:
    """``min_width`` of each column: the longest piece that can't be broken, over its cell's columns, rounded down.

    Words may break after slashes and hyphens between letters.
    """
    pieces = F.split(text, r"\s+|(?<=[A-Za-z][/-])(?=[A-Za-z])")
    longest = F.coalesce(F.array_max(F.transform(pieces, lambda w: F.length(w))), F.lit(0))
    return cells.groupBy(table, col).agg(F.max(F.floor(longest / F.col(colspan))).cast("long").alias("min_width"))


def pad_columns(widths: DataFrame, *, table: str, col: str, width: int) -> DataFrame:
    """Two columns of padding each, widest column first, as long as more than two spare ones remain of ``width``."""
    w = W.partitionBy(table)
    ranked = widths.withColumns({"_total": F.sum("min_width").over(w), "_rank": F.row_number().over(w.orderBy(F.desc("min_width"), col))})
    left = F.lit(width) - F.col("_total") - 2 * (F.col("_rank") - 1)
    return ranked.withColumn("width", F.col("min_width") + F.when(left > 2, 2).otherwise(0)).drop("_total", "_rank")


def author_list(authors: DataFrame, *, by: list[str], pos: str, first: Column, last: Column, editor: Column) -> DataFrame:
    """"A, B, and C" for each group: all but the last author as ``first``, the last of several as ``last``; ", Ed." after editors; "A and B" for two."""
    rows = authors.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), first.alias("first"), last.alias("last"), editor.alias("ed")))).alias("a"))
    n = F.size("a")
    one = lambda x, i: F.concat(F.when((i == n - 1) & (n > 1), F.concat(F.lit("and "), x["last"])).otherwise(x["first"]), F.when(x["ed"], ", Ed.").otherwise(""))
    sep = lambda x, i: F.concat(one(x, i), F.when((n == 2) & (i == 0), " ").when(i < n - 1, ", ").otherwise(""))
    return rows.select(*by, F.array_join(F.transform("a", sep), "").alias("authors"))


def inner_text(rows: DataFrame, *, by: list[str], pos: str, text: str) -> DataFrame:
    """The texts of a group in order, joined."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))


def subtree_text(el: DataFrame) -> DataFrame:
    """``doc_id``, ``node_id``, ``text``: each element's own text, and its descendants' with their tails, in document order.

    A descendant gives its text at its own place and its tail after its last descendant.
    """
    inside = el.filter("kind = 'element'").select("doc_id", F.explode(F.concat("anc_ids", F.array("node_id"))).alias("top"), "node_id", F.struct(F.col("node_id").cast("double").alias("p"), F.lit(0).alias("d"), F.coalesce("text", F.lit("")).alias("t")).alias("s"))
    tails = el.select("doc_id", F.explode("anc_ids").alias("top"), "node_id", F.struct((F.col("last_desc").cast("double") + 0.5).alias("p"), (-F.col("depth")).alias("d"), F.coalesce("tail", F.lit("")).alias("t")).alias("s"))
    rows = inside.unionByName(tails)
    return rows.groupBy("doc_id", F.col("top").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "").alias("text"))


def document_summary(rows: DataFrame, *, doc: str, fields: dict[str, Column], pos: str) -> DataFrame:
    """One row for each document: for each name in ``fields`` the first value in order that isn't null."""
    return rows.groupBy(doc).agg(*[F.min_by(c, F.when(c.isNotNull(), F.col(pos))).alias(n) for n, c in fields.items()])


def selector_coverage(rules: DataFrame, hits: DataFrame, *, key: str) -> DataFrame:
    """``key``, ``n``: the hits of each rule, rules without any included."""
    return rules.join(hits.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def inconsistent_values(rows: DataFrame, *, key: str, col: str) -> DataFrame:
    """Keys whose rows give different values: ``n_values`` and the values, sorted."""
    d = rows.filter(F.col(col).isNotNull()).groupBy(key, col).agg(F.lit(1).alias("one"))
    return d.groupBy(key).agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_list(F.col(col).cast("string"))), ",").alias("vals")).filter("n_values > 1")


def fill_agreed(rows: DataFrame, *, key: str, col: str) -> DataFrame:
    """``rows`` with nulls of ``col`` filled by the one value that the other rows of their key give; where those differ, nulls stay."""
    one = rows.filter(F.col(col).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).filter("_lo = _hi")
    out = rows.join(one, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(c, "_lo").alias(c) if c == col else F.col(c) for c in rows.columns])


def mixed_content(el: DataFrame, *, by: list[str], is_block: Column, has_text: Column) -> DataFrame:
    """Parents that hold both blocks and text."""
    return el.groupBy(*by).agg(F.max(is_block).alias("b"), F.max(has_text).alias("t")).filter("b AND t").select(*by)
