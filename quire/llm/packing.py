"""Best-fit packing: documents into training sequences of a fixed length, kept apart from their copies and sources.

Pieces go into the open bin that they fill best and whose bitmaps allow them: no bin holds two documents of one duplicate
cluster, nor more than ``max_per_source`` of one source. Open bins are in order of what is left in them; the search starts
at the first that is large enough and goes on to its successors until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bin's number is its group's number times this, and its own number in the group.
BINS = 1 << 24
#: Copies of a row that one array numbers.
COPIES = 1 << 15


def best_fit(sizes: list[int], sources: list, clusters: list, *, capacity: int, max_per_source: int) -> list[tuple[int, int]]:
    """Bin and offset for each piece, taken in the order given; a source or cluster of None conflicts with nothing.

    A bin's bitmaps are integers: one bit a cluster, and for sources ``max_per_source`` bitmaps, the k-th with the sources
    that the bin holds more than k documents of.
    """
    bit_of: dict = {}
    bit = lambda kind, x: 0 if x is None or x != x else 1 << bit_of.setdefault((kind, x), len(bit_of))
    order: list[tuple[int, int]] = []  # (left, bin) of open bins
    held: list[list[int]] = []  # for each bin: clusters, then the levels of sources
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = bit("s", source), bit("c", cluster)
        i = bisect_left(order, (size, -1))
        while i < len(order) and (held[order[i][1]][0] & c or held[order[i][1]][-1] & s):
            i += 1
        if i < len(order):
            left, b = order.pop(i)
        else:
            left, b = capacity, len(held)
            held.append([0] * (1 + max_per_source))
        bits = held[b]
        bits[0] |= c
        for k in range(1, 1 + max_per_source):
            if not bits[k] & s:
                bits[k] |= s
                break
        placed.append((b, capacity - left))
        if left > size:
            insort(order, (left - size, b))
    return placed


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: null for one of the rows that are equal in all columns, 1 and so on for the others.

    Equal rows are counted, in part before the shuffle, and made again by number, so that a row of any number of copies is one
    row of its task; numbers follow from counts, so a task that runs again gives the same.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_k"))
    some = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    each = some.select(*rows.columns, F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_k")) - 1)).alias("_copy"))
    return each.select(*rows.columns, F.when(F.col("_copy") > 0, F.col("_copy")).alias("copy"))


def pack(lengths: DataFrame, *, capacity: int = 4096, max_per_source: int = 2, group: int = 2048, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster", n_rows: int | None = None) -> DataFrame:
    """Every row of ``lengths`` placed: ``bin_id``, ``bin_start``, ``doc_id``, ``piece``, ``doc_start``, ``n_tokens``.

    A document longer than ``capacity`` is cut into full pieces and a rest; each is placed, so nothing is truncated. Tokens
    [doc_start, doc_start + n_tokens) of the document are at bin_start of its bin. Pieces meet in groups of about ``group``
    documents by a hash of id, piece, length, source and cluster, longest first (then by id and piece); bins never span groups,
    which costs less than a bin for each group. Rows equal in all of these are counted first and then numbered, and the
    number is hashed too, so repeated rows are dealt to groups as others are. Two shuffles of a few numbers a piece; a task
    holds one group at a time.

    Null and negative lengths count as 0, and documents of length 0 are placed too. Null sources or clusters conflict with
    nothing. Rows of one id are documents of their own. ``n_rows`` saves counting the rows, where it is known.
    """
    n_groups = max(1, -(-(lengths.count() if n_rows is None else n_rows) // group))
    kind = dict(lengths.dtypes)[id_col]
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    src = lengths.select(F.col(id_col).alias("doc_id"), n.alias("n"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    src = copies(src)
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    pieces = src.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", "n", "source", "cluster", "copy", (F.col("piece") * capacity).alias("doc_start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "n", "source", "cluster", "copy"), F.lit(n_groups))).drop("n", "copy")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        at = best_fit(rows.n_tokens.tolist(), rows.source.tolist(), rows.cluster.tolist(), capacity=capacity, max_per_source=max_per_source)
        rows["bin_id"] = [key[0] * BINS + b for b, _ in at]
        rows["bin_start"] = [s for _, s in at]
        return rows[["bin_id", "bin_start", "doc_id", "piece", "doc_start", "n_tokens"]]

    return pieces.groupBy("g").applyInPandas(run, f"bin_id long, bin_start long, doc_id {kind}, piece long, doc_start long, n_tokens long")


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, **how) -> DataFrame:
    """:func:`pack` for a table of documents, lengths in tokens; equal texts, but for case and space at the ends, are a cluster.

    Null and empty texts have length 0 and no cluster. Without a column ``source``, no document has one; other columns are
    not read, whatever their names. An empty table packs to an empty one.
    """
    from quire.llm.token_counts import encoded_lengths

    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    keyed = docs.select("doc_id", source.alias("source"), "text", F.when(F.length("text") > 0, F.xxhash64(F.lower(F.btrim("text")))).alias("cluster"))
    return pack(encoded_lengths(keyed, tokenizer=tokenizer, keep=("doc_id", "source", "cluster")), n_rows=docs.count(), **how)
