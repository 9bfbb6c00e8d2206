"""Token-ID output: ids in files of compressed planes with a chunk index, and back.

A file set is a Parquet folder whose rows are containers. A container holds consecutive documents of one shard, about
``container`` ids or one longer document: their ids and lengths, and all their token ids in blocks of ``block`` ids.
Each block is transposed into 32 bit planes or 4 byte planes, each compressed alone with zstandard; plane p of block k is
``data[index[k * planes + p] : index[k * planes + p + 1]]``. High planes of small ids are constant and shrink to a few
bytes. Shards are numbered in ascending order of documents, and a container
says how many ids of its shard come before it. Containers are read alone, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import shuffle_partitions
from quire.llm.encoder import default_tokenizer, encoder
from quire.llm.words import slices

SCHEMA = "shard int, first long, n_ids long, planes int, block int, doc_ids array<long>, doc_lens array<long>, index array<long>, data binary"


def pack(ids: bytes, planes: int, block: int) -> tuple[list[int], bytes]:
    """The chunk index and the data of little-endian unsigned 32-bit ids; planes are 32 (bits) or 4 (bytes)."""
    import zstandard

    put, parts, index = zstandard.ZstdCompressor(level=3).compress, [], [0]
    rows = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    for at in range(0, len(rows), block):
        b = rows[at : at + block]
        cut = np.packbits(np.unpackbits(b, axis=1, bitorder="little").T, axis=1) if planes == 32 else np.ascontiguousarray(b.T)
        for plane in cut:
            parts.append(put(plane.tobytes()))
            index.append(index[-1] + len(parts[-1]))
    return index, b"".join(parts)


def unpack(index: list[int], data: bytes, planes: int, block: int, n_ids: int) -> bytes:
    """The inverse of :func:`pack`."""
    import zstandard

    get, out = zstandard.ZstdDecompressor().decompress, []
    for k in range((len(index) - 1) // planes):
        n = min(block, n_ids - k * block)
        cut = [np.frombuffer(get(data[index[i] : index[i + 1]]), dtype=np.uint8) for i in range(k * planes, (k + 1) * planes)]
        if planes == 32:
            bits = np.unpackbits(np.stack(cut), axis=1, count=n)
            out.append(np.packbits(bits.T, axis=1, bitorder="little").tobytes())
        else:
            out.append(np.stack(cut, axis=1).tobytes())
    return b"".join(out)


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int | None = 1, planes: str = "byte", block: int = 1 << 16, container: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the file set to ``path``, in ascending order of id.

    ``end_id`` is appended to each document (None: nothing is). Null and empty texts have no other ids. Null ids come
    first; rows of one id are all written, in the order of their texts. Other columns are not written.

    Texts shuffle once, by ranges of ids; encoding happens after that, so ids never shuffle. Memory is one container's.
    """
    tok, n_planes = tokenizer or default_tokenizer(), {"bit": 32, "byte": 4}[planes]
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src = src.repartitionByRange(shuffle_partitions(docs), "id").sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, first = encoder(tok), TaskContext.get().partitionId(), 0
        names = ["shard", "first", "n_ids", "planes", "block", "doc_ids", "doc_lens", "index", "data"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def row(doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
            ids = b"".join(parts)
            index, data = pack(ids, n_planes, block)
            values = (shard, first, len(ids) // 4, n_planes, block, doc_ids, [len(p) // 4 for p in parts], index, data)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        doc_ids, parts, size = [], [], 0
        for b in batches:
            for at, part in slices(b.column(1)):
                ids, n = enc.encode(part)
                ends = np.cumsum(n).tolist()
                for i, start, stop in zip(b.column(0).slice(at, len(part)).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                    doc_ids.append(i)
                    parts.append(ids[start:stop].tobytes() + end)
                    size += len(parts[-1]) // 4
                    if size >= container:
                        yield row(doc_ids, parts)
                        doc_ids, parts, size, first = [], [], 0, first + size
        if doc_ids:
            yield row(doc_ids, parts)

    src.mapInArrow(encode, SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of a file set.

    Starts come from the containers' counts alone: one small window over shards, of which there are as many as the writer
    had partitions.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, at, out = unpack(r["index"], r["data"], r["planes"], r["block"], r["n_ids"]), 0, []
                first, shard = r["first"], r["shard"]
                for n in r["doc_lens"]:
                    out.append((first + at, n, ids[4 * at : 4 * (at + n)]))
                    at += n
                cols = [pa.array([shard] * len(out), pa.int32()), pa.array(r["doc_ids"], pa.int64())]
                cols += [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "at", "n_tokens", "ids"])

    rows = files.mapInArrow(decode, "shard int, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, from files written to ``path`` and read back."""
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
