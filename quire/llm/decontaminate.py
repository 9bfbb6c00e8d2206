"""Benchmark decontamination: find test passages in training texts, and cut them out or drop the texts. DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A window is ``n`` consecutive words of an
item; an item of fewer words, but not none, is one window.

A window of ``L`` words that starts anywhere in a document holds, whole, one of the document's grams of ``g`` words taken
every ``L - g + 1`` words. So only those few grams are hashed and looked up in the set of all the items' grams; where one
hits, the windows around it are compared as strings, so no hash decides a result. Documents are read once and their texts
never shuffle: what shuffles is a narrow row for each document and one for each window around a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SMALL, boxed, lower_ascii, materialize, own_columns

#: Characters that are no part of a word: ASCII without digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS, -1), lambda w: w != "")


def _gram_hash(words: str, start: str, size: int) -> str:
    return f"xxhash64(slice({words}, {start} + 1, {size}))"


def _gram_size(length: int) -> int:
    return (length + 1) // 2


def item_windows(benchmark: DataFrame, *, item_col: str, text_col: str, n: int) -> DataFrame:
    """Each different window: ``window`` (words joined by spaces), ``n_words``, ``items`` (the sorted ids that hold it as text)."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    rows = words.select("item", size.alias("n_words"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("window"))
    return rows.groupBy("window", "n_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _grams(windows: DataFrame, length: int) -> DataFrame:
    g = _gram_size(length)
    rows = windows.filter(F.col("n_words") == length).select(F.split("window", " ").alias("w"))
    return rows.select(F.explode(F.expr(f"transform(sequence(0, {length - g}), i -> {_gram_hash('w', 'i', g)})")).alias("g")).distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_set: int = 50_000) -> DataFrame:
    """One row for each different (id, text) of ``docs``: ``doc_id``, ``text_hash``, ``n_words``, ``spans``, ``n_hit``, ``items``.

    ``spans`` are the word ranges [start, end) of occurring windows, sorted; ``n_hit`` the words they cover; ``items`` the
    sorted ids (as text) of the items with an occurring window.

    The set of the items' grams is measured first. Up to ``max_set`` of them go with the plan as a hash set that every
    task probes in place; beyond that the texts' gram hashes are joined with the items' (which are broadcast up to a
    million), and windows are built in a second pass, around hits alone; the result is the same.

    Null or empty texts have no words; null items and items without words have no windows. Rows that repeat an id and a
    text are one row here; rows of one id with different texts stay apart.
    """
    windows = item_windows(benchmark, item_col=item_col, text_col=item_text_col, n=n)
    lengths = sorted(r[0] for r in windows.select("n_words").distinct().collect())  # at most n values
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h1"), F.xxhash64(F.lit(0x51ED27), text_col).alias("_h2"), words_of(F.col(text_col)).alias("w"))

    grams = {length: materialize(_grams(windows, length)) for length in lengths}
    starts = {length: f"CASE WHEN size(w) >= {length} THEN sequence(0, size(w) - {_gram_size(length)}, {length - _gram_size(length) + 1}) ELSE cast(array() AS array<int>) END" for length in lengths}
    if sum(g.count() for g in grams.values()) <= max_set:
        for length in lengths:
            known = ", ".join(f"{x}L" if x > -(2**63) else "-9223372036854775807L - 1L" for x in (r[0] for r in grams[length].collect()))
            starts[length] = f"filter({starts[length]}, p -> {_gram_hash('w', 'p', _gram_size(length))} IN ({known}))"
    elif lengths:
        # 20 bytes for each gram of a text meet the items' grams; only where they hit do windows become strings
        rows = [base.select("_id", "_h1", "_h2", F.explode(F.expr(f"transform({starts[n]}, p -> struct({n} AS n, p, {_gram_hash('w', 'p', _gram_size(n))} AS g))")).alias("x")).select("_id", "_h1", "_h2", "x.*") for n in lengths]
        hits = [r.join(F.broadcast(grams[n]) if grams[n].count() <= SMALL else grams[n], "g").select("_id", "_h1", "_h2", "n", "p") for r, n in zip(rows, lengths, strict=True)]
        every = hits[0]
        for h in hits[1:]:
            every = every.unionByName(h)
        every = materialize(every.groupBy("_id", "_h1", "_h2").agg(F.collect_set(F.struct("n", "p")).alias("_hits")).select(F.col("_id").alias("_i"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), "_hits"))
        if every.count() <= SMALL:
            every = F.broadcast(every)
        base = base.join(every, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_h1").eqNullSafe(F.col("_a")) & F.col("_h2").eqNullSafe(F.col("_b")), "left").drop("_i", "_a", "_b")
        starts = {n: f"transform(filter(coalesce(_hits, array()), x -> x.n = {n}), x -> x.p)" for n in lengths}
    found = []
    for length in lengths:
        stride = length - _gram_size(length) + 1
        around = f"sequence(greatest(p - {stride - 1}, 0), least(p, size(w) - {length}))"
        found.append(f"flatten(transform({starts[length]}, p -> transform({around}, s -> struct(s AS start, s + {length} AS end, array_join(slice(w, s + 1, {length}), ' ') AS window))))")
    none = "cast(array() AS array<struct<start: int, end: int, window: string>>)"
    near = F.expr(f"concat({', '.join(found)})") if found else F.expr(none)
    rows = base.select("_id", "_h1", "_h2", F.size("w").alias("_n"), F.array_distinct(near).alias("_near"))
    rows = rows.select("_id", "_h1", "_h2", "_n", F.explode_outer("_near").alias("_s"))

    marked = windows.select(F.col("window").alias("_w"), "items")
    if windows.limit(SMALL + 1).count() <= SMALL:
        marked = F.broadcast(marked)
    hit = rows.join(marked, F.col("_s.window") == F.col("_w"), "left")
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("_s.start").alias("start"), F.col("_s.end").alias("end")))
    out = hit.groupBy("_id", "_h1", "_h2").agg(F.max("_n").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = "aggregate(spans, struct(0L AS hit, 0 AS upto), (a, s) -> struct(a.hit + greatest(0, s.end - greatest(s.start, a.upto)) AS hit, greatest(a.upto, s.end) AS upto), a -> a.hit)"
    return out.select(F.col("_id").alias("doc_id"), F.struct("_h1", "_h2").alias("text_hash"), "n_words", "spans", F.expr(covered).cast("long").alias("n_hit"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without what the benchmark holds, all their columns kept.

    ``remove="documents"`` drops rows with any hit word, ``"spans"`` cuts the hit words out, with the gap before each of
    them, and leaves all else as it is. Rows with nothing hit come back unchanged, nulls and repeated rows included.
    """
    hits = find_windows(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter(F.col("n_hit") > 0)
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash._h1").alias("_h1"), F.col("text_hash._h2").alias("_h2"), F.col("spans").alias("_spans"))
    keyed = boxed(docs, text=F.col(text_col), id=F.col(id_col), k1=F.xxhash64(text_col), k2=F.xxhash64(F.lit(0x51ED27), text_col))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_h1")) & (F.col("k2") == F.col("_h2"))
    if remove == "documents":
        hits = materialize(hits.select("_id", "_h1", "_h2"))
        if hits.count() <= SMALL:
            hits = F.broadcast(hits)  # else texts shuffle to meet it
        return keyed.join(hits, same, "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    joined = keyed.join(hits, same, "left")
    # a text is a gap (maybe empty), then words each followed by a gap; word i and the gap before it go together
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = f"regexp_extract_all(text, r'([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)({word})', 0)"
    tail = f"regexp_extract(text, r'[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*\\z', 0)"
    gone = "flatten(transform(_spans, s -> sequence(s.start, s.end - 1)))"
    cut = f"concat(array_join(transform(array_except(sequence(0, size({pieces}) - 1), {gone}), i -> get({pieces}, i)), ''), {tail})"
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(cut))
    return joined.select(*[text.alias(c) if c == text_col else x for c, x in zip(docs.columns, own_columns(docs), strict=True)])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = find_windows(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), bl AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0
), bs AS (
  SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM bl
), bg AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS window FROM bs
), ns AS (
  SELECT DISTINCT n FROM bg
), ds AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM dw, ns WHERE len(w) >= n
), dg AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS window FROM ds
), h AS (
  SELECT dg.doc_id, dg.s, dg.n, bg.item_id FROM dg JOIN bg ON dg.window = bg.window AND dg.n = bg.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""
