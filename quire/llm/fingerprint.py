"""Document fingerprints: content-defined chunks, and how much of one text another one contains.

A gear hash of the last 32 bytes runs over a text's UTF-8. A chunk ends where its upper bits are zero: more bits are asked
for before the usual chunk length than after it ("normalised"), so lengths gather around it; a least and a greatest
length hold. Boundaries depend on nearby bytes only, so inserting or moving text changes the chunks around it and no others.
The fingerprint is the set of chunk digests, each weighted by its chunk's bytes.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import shuffle_partitions

LEAST, USUAL, GREATEST = 16, 64, 256
#: Zero bits asked for before and after the usual length.
HARD, EASY = 7, 5


@functools.lru_cache(maxsize=1)
def _gear():
    """256 numbers of 32 bits, one for each byte value: a multiplicative mix of it."""
    import numpy as np

    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where each chunk of ``data`` ends; none for no data."""
    import numpy as np

    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _gear()[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after this h[i] is the gear hash of the 32 bytes up to i
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY)))
    hard = (easy[h[easy] < np.uint32(1 << (32 - HARD))] + 1).tolist()
    easy, ends, start = (easy + 1).tolist(), [], 0
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST)
        if i < len(hard) and hard[i] < start + USUAL:
            end = hard[i]
        else:
            i = bisect_left(easy, start + USUAL)
            end = min(easy[i] if i < len(easy) else n, start + GREATEST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str | None) -> dict[int, int]:
    """Chunk digest to chunk bytes; empty for null and empty texts."""
    import xxhash

    data, start, out = (text or "").encode("utf-8", "surrogatepass"), 0, {}
    for end in chunk_ends(data):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def as_text(fp: dict[int, int]) -> str:
    """A fingerprint as a string: ``digest:bytes`` in hex, in order of digest."""
    return " ".join(f"{d:016x}:{n:x}" for d, n in sorted(fp.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of ``a``'s weight whose chunks ``b`` has. An empty ``a`` is contained wholly in an empty ``b`` and in no other."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row; null and empty texts have ''. No shuffle."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(fingerprint(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return src.mapInArrow(run, src.select("doc_id").schema.add("fingerprint", "string"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """Rows dealt and sorted so that each is followed by the next one in descending order of id: ``bucket``, ``halo``, ``id``, ``text``.

    Ids are cut into ranges ("buckets") at approximate quantiles. Each bucket gets, behind its own rows, a copy of the first
    row after it (``halo`` 1): the first of the next lower bucket, or of the highest one for the lowest. What the driver
    sees is one id for each bucket. Texts shuffle once. Rows of one id are in order of their texts; null ids come last.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = shuffle_partitions(docs)
    marks = src.agg(F.percentile_approx("id", [i / (n * per_partition) for i in range(1, n * per_partition)], 10 * n * per_partition).alias("m")).first()["m"] or []
    cuts = sorted(set(marks))
    keyed = src.withColumn("bucket", _bucket_of("id", cuts))
    firsts = sorted(((r["bucket"], r["m"]) for r in keyed.groupBy("bucket").agg(F.max("id").alias("m")).collect()), reverse=True)
    follow = [(firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    halo = F.broadcast(docs.sparkSession.createDataFrame(follow, "hid long, target int"))
    own = keyed.select("bucket", F.lit(0).alias("halo"), "id", "text")
    copies = src.join(halo, F.col("id").eqNullSafe(F.col("hid"))).select(F.col("target").alias("bucket"), F.lit(1).alias("halo"), "id", "text")
    return own.unionByName(copies).repartition(n, "bucket").sortWithinPartitions("bucket", "halo", F.col("id").desc_nulls_last(), "text")


def _bucket_of(col: str, cuts: list[int]) -> Column:
    """The number of sorted ``cuts`` below a column, by binary search in a literal array; 0 for null."""
    bits = len(cuts).bit_length()
    at = f"lo + shiftleft(1, {bits} - step)"
    return F.expr(f"aggregate(sequence(1, {bits}), 0, (lo, step) -> CASE WHEN get(array({', '.join(f'{x}L' for x in cuts)}), {at} - 1) < {col} THEN {at} ELSE lo END)") if cuts else F.lit(0)


def edited(text: str, following: str) -> str:
    """``text`` with its second half (the smaller one, in code points) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each document held against its edited text and the next document."""
    import hashlib

    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, id, text, fingerprint of the row that waits for its next one
        for b in batches:
            out = []
            for bucket, halo, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if last is None or last[0] != bucket:
                    last = None if halo else (bucket, i, text, fingerprint(text))
                    continue
                fp, whole = fingerprint(text), edited(last[2], text)
                ep = fingerprint(whole)
                out.append((last[1], len(last[2]), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), as_text(last[3]), as_text(ep), containment(last[3], ep), containment(last[3], fp)))
                last = None if halo else (bucket, i, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
