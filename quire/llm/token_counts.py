"""Token counts: the exact histogram of encoded lengths, and what follows from it for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize
from quire.llm.encoder import default_tokenizer, encoder
from quire.llm.words import slices


def encoded_lengths(docs: DataFrame, *, tokenizer: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; null and empty texts have 0. No shuffle, texts are not returned."""
    path = tokenizer or default_tokenizer()
    src = docs.select(*keep, F.col(text_col))  # by place, so that names cannot clash
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array(np.concatenate([np.zeros(0, np.int64), *[enc.lengths(part) for _, part in slices(b.column(len(keep)))]]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], [*keep, "n_tokens"])

    return src.mapInArrow(count, schema)


def length_histogram(lengths: DataFrame, *, col: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row for each length that occurs: ``n_tokens``, ``n_docs``, and with this length as the context limit

    - ``n_fit``, ``fit_tokens``: documents that are no longer than it, and their tokens
    - ``n_longer``, ``longer_tokens``: documents that are longer, and their tokens
    - ``truncated_total``: tokens left when every document is cut to it
    - ``quantile``: share of documents that fit

    Null lengths are left out. An empty table has no rows. Lengths are added up in blocks first: the one window without a
    partition runs over blocks, of which there are as many as the longest document has thousands of tokens.
    """
    hist = lengths.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    hist = materialize(hist)  # it is used twice, and is small
    hist = hist.withColumns({"_block": F.floor(F.col("n_tokens") / block), "_tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    before, every = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in ("_d", "_t")], F.sum("_d").over(every).alias("_all_d"), F.sum("_t").over(every).alias("_all_t"))
    upto = W.partitionBy("_block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    out = hist.join(blocks, "_block").withColumns({"n_fit": F.sum("n_docs").over(upto) + F.col("_d_before"), "fit_tokens": F.sum("_tokens").over(upto) + F.col("_t_before")})
    out = out.withColumns({"n_longer": F.col("_all_d") - F.col("n_fit"), "longer_tokens": F.col("_all_t") - F.col("fit_tokens")})
    return out.select("n_tokens", "n_docs", "n_fit", "fit_tokens", "n_longer", "longer_tokens", (F.col("fit_tokens") + F.col("n_tokens") * F.col("n_longer")).alias("truncated_total"), (F.col("n_fit") / F.col("_all_d")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit``, ``n_fit``, ``truncated_total`` for limits of any value, from :func:`length_histogram`; zeros for an empty one."""
    spark = histogram.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    per = histogram.select("n_tokens", "n_docs").join(wanted, F.lit(True), "right").groupBy("context_limit")
    return per.agg(F.coalesce(F.sum(F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_docs"))), F.lit(0)).alias("n_fit"), F.coalesce(F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length ``n_tokens`` that a share ``q`` of the documents doesn't exceed: one row, null for an empty histogram."""
    return histogram.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
