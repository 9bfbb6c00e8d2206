"""Line dedup: lines that many documents hold stay in one of them only. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SMALL, SPACES, boxed, hash128, lower_ascii, materialize, own_columns


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hashed(key: Column) -> Column:
    """The key's two hashes, or null for a key too short to count."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x51ED27), key).alias("h2"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated lines, and ``n_lines`` (before) and ``n_dropped`` added.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
    that at least ``min_docs`` different ids hold lose all their lines except in the largest id holding them.

    Null or empty texts are one empty line, and come back as ''. Rows of one id count as one document: a key in two of
    them counts once, and the largest id keeps its lines in all its rows. A null id never counts towards a key's documents
    and loses the lines of every dropped key. Rows of one id may differ in text: each loses its own lines, found by the id
    and a 128-bit hash of the text. All other columns pass through; columns of ``docs`` named ``n_lines`` or ``n_dropped``,
    in any case, are replaced. ``how``: ``id_col``, ``min_chars`` (20) and ``min_docs`` (3).

    Only hashes and positions are exploded, and written once: 60 bytes for each line that is long enough. Counting is
    partial before it shuffles, so a line in a third of all documents costs a row per task. The keys to drop are written and
    counted: up to a million go to every task, more meet the lines by a shuffle. Texts shuffle once, to meet their dropped
    positions.
    """
    counted = [F.col("n_lines"), F.col("n_dropped")]
    texts = [F.col("text").alias(c) if c == text_col else x for c, x in zip(docs.columns, own_columns(docs), strict=True) if c.lower() not in ("n_lines", "n_dropped")]
    return _deduped(docs, text_col=text_col, **how).select(*texts, *counted)


def dedup_texts(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` as :func:`dedup_lines` leaves their texts, with their own columns only, whatever their names."""
    return _deduped(docs, text_col=text_col, **how).select(*[F.col("text").alias(c) if c == text_col else x for c, x in zip(docs.columns, own_columns(docs), strict=True)])


def _deduped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``row``, all of a document's columns, and ``text``, ``n_lines``, ``n_dropped``."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    hashed = docs.select(F.col(id_col).alias("_id"), hash128(text_col).alias("_t"), F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.when(F.length(F.btrim(x, F.lit(SPACES))) >= min_chars, _hashed(_key(x))).alias("k"))).alias("_l"))
    rows = hashed.select("_id", "_t", F.explode(F.filter("_l", lambda x: x["k"].isNotNull())).alias("_l")).select("_id", F.col("_t.a").alias("_a"), F.col("_t.b").alias("_b"), "_l.pos", "_l.k.h1", "_l.k.h2")
    rows = materialize(rows)  # texts are split and hashed once; these rows are read twice

    seen = rows.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
    common = seen.groupBy("h1", "h2").agg(F.count("_id").alias("_n"), F.max("_id").alias("_keep")).filter(F.col("_n") >= min_docs).select("h1", "h2", "_keep")
    common = materialize(common)
    if common.count() <= SMALL:
        common = F.broadcast(common)  # 24 bytes a row; beyond, a shuffled join that adaptive execution can split

    drops = rows.join(common, ["h1", "h2"]).filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    drops = drops.groupBy("_id", "_a", "_b").agg(F.collect_set("pos").alias("_drops"))

    nothing = F.array().cast("array<int>")
    out = boxed(docs, _text=F.col(text_col), _key=F.col(id_col), _t=hash128(text_col))
    out = out.join(drops, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_t.a") == F.col("_a")) & (F.col("_t.b") == F.col("_b")), "left")
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    out = out.withColumn("_lines", lines).withColumn("_drops", F.coalesce("_drops", nothing))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    text = F.when(F.size("_drops") == 0, F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return out.select("row", text.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_drops").cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the operator's texts."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keep <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
