"""LM scoring: a hierarchical Pitman-Yor bigram model, seated by Gibbs sampling, and texts scored with it.

Restaurants. The lower one is shared by all contexts: its dishes are all learnt tokens, its base spreads half its mass over
them and gives the other half to one token that stands for all unknown ones. Above it, each token is the context of a
restaurant of its own, whose customers are the tokens that follow it; each of its tables is one customer of the shared
restaurant. Every pair of consecutive tokens that occurs has seats, pairs seen once too; nothing is left out.

Where things are. Texts are cut into blocks inside tasks. A block's pairs, with how often each of its texts has them, are
dealt by their context's hash to buckets of about ``bucket_tokens`` tokens (a context with more than a quarter of that
is dealt by pair), and shuffle once, packed into arrays. A bucket then holds its contexts' restaurants whole, learns, and
scores its pairs for every text; what goes back is three sums for each text. Words and their shared probabilities are a
table that meets the buckets by shuffles. The most frequent tokens, a fixed number, have short codes that every task knows.

Gibbs. Blocks of variables are drawn from their exact conditionals, so contexts can be drawn at the same time:

- y of each context, given its tables: Gamma(theta / d + tables). Given y, the tables of its dishes are independent.
- the tables t of a dish with c customers, given y and the dish's shared probability q: proportional to
  (d y q)^t S(c, t), S being the generalised Stirling numbers; exactly up to 256 customers, beyond that from a binomial
  with the mean and the deviation that its saddle point gives (within 2.5 %). One customer has one table.
- the same for the shared restaurant, given the tables above it.
- q itself, given the shared tables: gammas that are divided by their sum (a Dirichlet draw).

Draws come from generators keyed by bucket and sweep, so a lost task draws as before. The discounts are n1 / (n1 + 2 n2),
from the numbers of pairs (for the shared restaurant: tokens) seen once and twice. Predictive probabilities given the seats
are averaged over the last sweeps, pair by pair.
"""

from __future__ import annotations

import gc
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import crc_fold, delete, materialize, scratch, shuffle_partitions, small_batches, stored
from quire.llm.words import bounds, mix, runs, slices, word_hashes

#: Bytes of a block of texts.
BLOCK = 2_500_000
#: Tokens with short codes (0 is the end of a text); all others are known by their hash, which is at least this.
HEAD = 65_535
#: Customers up to which tables are drawn exactly.
EXACT = 256
END = np.zeros(1, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts (words, then END, for each) and the number of tokens of each text."""
    parts, sizes = [], []
    for t in texts:
        parts += word_hashes(t), END
        sizes.append(len(parts[-2]) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, dtype=np.int64)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, whole numbers in the least type that holds them, byte plane by byte plane."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        parts += struct.pack("<cQ", a.dtype.char.encode(), len(a)), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T if len(a) else a).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def load(data: bytes) -> list[np.ndarray]:
    """The inverse of :func:`dump`."""
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<cQ", data, at)
        size = np.dtype(kind.decode()).itemsize
        planes = np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at + 9).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind.decode()))
        at += 9 + n * size
    return out


def _short(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as two-byte codes, and the hashes of those that have none."""
    return np.minimum(keys, HEAD).astype(np.int64), keys[keys >= HEAD]


def _long(codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    keys = codes.astype(np.uint64)
    keys[codes == HEAD] = rare
    return keys


# -- drawing tables


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of discount ``d``; minus infinity where t > c or t = 0."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], s[c, 1 : c + 2] + np.log(np.maximum(c - d * np.arange(1, c + 2), 0)))
    return s


def _lgamma(z: np.ndarray) -> np.ndarray:
    out, z = -np.log(z * (z + 1) * (z + 2) * (z + 3)) - np.log((z + 4) * (z + 5) * (z + 6) * (z + 7)), z + 8
    return out + (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3)


def _digamma(z: np.ndarray) -> np.ndarray:
    out, z = -sum(1 / (z + k) for k in range(8)), z + 8
    return out + np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4)


def expected_tables(c: np.ndarray, x: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t under x^t S(c, t), for many customers, at the saddle point.

    There, a dish grows as a restaurant of strength x - d t does; its expected tables are known in closed form, which
    gives log x as a rising function of that strength, and the variance from its slope.
    """
    lo, hi, want = np.full(len(c), -d + 1e-9), np.maximum(x, 1.0) * 2 + c, np.log(x)
    value = lambda s: _lgamma(s + 1) - _lgamma(s + d) + _lgamma(c + s + d) - _lgamma(c + s)
    for _ in range(60):
        mid = np.where(lo > 1, np.sqrt(np.maximum(lo, 1e-9) * np.abs(hi)), (lo + hi) / 2)
        above = value(mid) > want
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    s = (lo + hi) / 2
    slope = _digamma(s + 1) - _digamma(s + d) + _digamma(c + s + d) - _digamma(c + s)
    return (x - s) / d, (x - 1 / slope) / d


def draw_tables(c: np.ndarray, x: np.ndarray, d: float, log_s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The tables t of dishes with ``c`` customers, from the distribution proportional to x^t S(c, t)."""
    t, x, u = np.ones(len(c), dtype=np.int64), np.maximum(x, 1e-300), rng.random(len(c))
    order = np.argsort(c, kind="stable")
    at = np.searchsorted(c[order], np.arange(EXACT + 2))
    for k in range(2, EXACT + 1):
        for some in np.array_split(order[at[k] : at[k + 1]], max(1, -(-(at[k + 1] - at[k]) * k // 1_000_000))):
            p = np.log(x[some])[:, None] * np.arange(1, k + 1) + log_s[k, 1 : k + 1]
            p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[some] = 1 + (p < (u[some] * p[:, -1])[:, None]).sum(axis=1)
    if len(many := order[at[EXACT + 1] :]):
        mean, variance = expected_tables(c[many].astype(float), x[many], d)
        # all tables but the first are a sum of independent yes-or-no draws: a binomial of the same mean and variance
        mean = np.clip(mean - 1, 1e-12, c[many] - 1)
        n = np.clip(np.ceil(mean**2 / np.maximum(mean - variance, mean * 1e-6)), np.ceil(mean), np.maximum(c[many] - 1, np.ceil(mean)))
        t[many] = 1 + rng.binomial(n.astype(np.int64), mean / n)
    return t


# -- counting, and dealing pairs to buckets


def count_tokens(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``h``, ``c``: every token's hash and count, the end of each text included. Blocks are counted before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in slices(b.column(0), BLOCK):
                h, c = np.unique(tokens(part.to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent tokens: their hashes in order, the code of each, and counts by code. Those below ``hot`` are dealt by pair."""

    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    hot: int
    n_buckets: int

    def keys(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.codes[at], np.maximum(h, np.uint64(HEAD)))


def _packed(docs: DataFrame, head: Head, kind: str) -> DataFrame:
    """``bucket``, ``batch``, ``ids``, ``data``: each block's pairs for each bucket, and a row (negative bucket) with its texts' ids and sizes."""
    shared, names = docs.sparkSession.sparkContext.broadcast(head), ["bucket", "batch", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, batch = shared.value, TaskContext.get().partitionId() << 24
        for b in batches:
            for first, texts in slices(b.column(2), BLOCK):
                ids, learn = b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                w, sizes = tokens(texts.to_pylist())
                known, at = np.unique(w, return_inverse=True)
                keys = head.keys(known)
                order = np.argsort(keys)
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                keys, at = keys[order], place[at]
                before = np.concatenate([[0], at[:-1]])  # 0 is the code of END: what ends one text precedes the next
                pair, at = np.unique(before * len(keys) + at, return_inverse=True)
                u, w = keys[pair // len(keys)], keys[pair % len(keys)]
                bucket = (mix(np.where(u < head.hot, mix(u * _M + w), u)) % np.uint64(head.n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                u, w, bucket = u[order], w[order], bucket[order]
                doc, at = np.repeat(np.arange(len(sizes)), sizes), place[at]
                c = np.bincount(at[learn[doc]], minlength=len(u))
                use, times = np.unique(at * len(sizes) + doc, return_counts=True)
                n_docs, doc = np.bincount(use // len(sizes), minlength=len(u)), use % len(sizes)
                ends = np.concatenate([[0], np.cumsum(n_docs)])
                cut = bounds([bucket])
                data = []
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    start = bounds([u[i:j]])
                    x, y = slice(i, j), slice(ends[i], ends[j])
                    data.append(dump(*_short(u[i:j][start[:-1]]), np.diff(start), *_short(w[x]), c[x], n_docs[x], doc[y], times[y]))
                which = [*bucket[cut[:-1]].tolist(), -1 - batch % head.n_buckets]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([batch] * len(which), pa.int64()), pa.array([None] * len(data) + [ids.to_pylist()], pa.list_(ids.type)), pa.array([*data, dump(sizes)], pa.binary())], names)
                batch += 1

    return docs.mapInArrow(run, f"bucket int, batch long, ids array<{kind}>, data binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each value of the first column."""
    for b in runs(batches):
        at = bounds([b.column(0).to_numpy()])
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield b.column(0)[i].as_py(), b.slice(i, j - i)


def _spread(rows: DataFrame, head: Head) -> int:
    return min(max(shuffle_partitions(rows), 3 * head.n_buckets), 100_000)  # what Spark lets a table have


def _each(rows: DataFrame, head: Head, by: str = "bucket") -> DataFrame:
    """One bucket a task or none, seldom two, which joins and groupings by bucket keep."""
    return rows.repartition(_spread(rows, head), by)


def _dealt(rows: DataFrame, head: Head, by: str, run, schema: str) -> DataFrame:
    """``run`` over the rows, those of each value of ``by`` (the first column) together."""
    return _each(rows, head, by).sortWithinPartitions(by).mapInArrow(run, schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's blocks as one: contexts ``u``, words ``w``, pairs of them with counts, and who uses each pair."""
    names = ["bucket", "batch", "ids", "pairs", "uses", "n1", "n2"]
    kinds = [pa.int32(), pa.int64(), None, pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    for bucket, rows in _groups(batches):
        kinds[2] = rows.schema.field("ids").type
        put = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(v, kinds, strict=True)], names)
        if bucket < 0:
            for r in rows.to_pylist():
                yield put(bucket, r["batch"], r["ids"], r["data"], None, None, None)
            continue
        order = np.argsort(rows.column(1).to_numpy(), kind="stable")
        blocks = [load(rows.column(3)[int(i)].as_py()) for i in order]
        u, at = np.unique(np.concatenate([np.repeat(_long(b[0], b[1]), b[2]) for b in blocks]), return_inverse=True)
        w, to = np.unique(np.concatenate([_long(b[3], b[4]) for b in blocks]), return_inverse=True)
        at *= len(w)
        at += to
        del to
        pair, at = np.unique(at, return_inverse=True)
        joined = lambda k: np.concatenate([b[k] for b in blocks])  # noqa: E731, B023
        c = np.bincount(at, weights=joined(5), minlength=len(pair)).astype(np.int64)
        sizes = np.array([len(b[5]) for b in blocks])
        step = np.diff(at, prepend=0)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        step[first] = at[first]
        pairs = dump(*_short(u), np.bincount(pair // len(w), minlength=len(u)), *_short(w), pair % len(w), c)
        yield put(bucket, None, None, pairs, dump(rows.column(1).to_numpy()[order], sizes, step, joined(6), np.array([len(b[7]) for b in blocks]), joined(7), joined(8)), int((c == 1).sum()), int((c == 2).sum()))


def _pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, and of each pair its context, word and count."""
    a = load(data)
    return _long(a[0], a[1]), _long(a[3], a[4]), np.repeat(np.arange(len(a[2])), a[2]), a[5].astype(np.int64), a[6].astype(np.int64)


# -- learning


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sweeps need of each bucket (``data``: pairs seen twice or more, all at one table), and each word's pairs seen once (``ones``)."""
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, w, at, to, c = _pairs(data)
            many, once = np.flatnonzero(c > 1), c == 1
            ones = np.bincount(to[once], minlength=len(w))
            word, to = np.unique(to[many], return_inverse=True)
            state = dump(np.minimum(u, HEAD).astype(np.int64), np.bincount(at[once], minlength=len(u)), *_short(w[word]), at[many], to, c[many], np.ones(len(many), np.int64))
            some = np.flatnonzero(ones)
            n = len(some) + 1
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int32()), pa.array([None, *w[some].view(np.int64).tolist()], pa.int64()), pa.array([None, *ones[some].tolist()], pa.int64()), pa.array([state] + [None] * (n - 1), pa.binary())], ["bucket", "w", "ones", "data"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket``, ``w``: the words without short codes that a bucket must look up."""
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rare = load(data)[3 if b.schema.names[1] == "data" else 4]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), bucket, dtype=np.int32)), pa.array(rare.view(np.int64))], ["bucket", "w"])


def _at_words(w: np.ndarray, head_values: np.ndarray, rare: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    """Values of words: by code for those that have one, else looked up among ``rare``."""
    out, short = np.full(len(w), default), w < HEAD
    code = w[short].astype(np.int64)
    out[short] = np.where(code < len(head_values), head_values[np.minimum(code, len(head_values) - 1)], default)
    if len(rare):
        order = np.argsort(rare)
        at = order[np.minimum(np.searchsorted(rare, w[~short], sorter=order), len(rare) - 1)]
        out[~short] = np.where(rare[at] == w[~short], values[at], default)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A bucket and its row."""
    for b in batches:
        for i, bucket in enumerate(b.column("bucket").to_pylist()):
            yield bucket, b.slice(i, 1)


def _found(row: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The looked-up words of a bucket, field by field; none for null."""
    flat = row.column("found").flatten()
    return {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _totals(u: np.ndarray, hot: int, own: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Values of contexts: their own sum in the bucket, or the sum over all buckets for those dealt by pair."""
    return np.where(u < hot, elsewhere[np.minimum(u, max(hot - 1, 0)).astype(np.int64)], own) if hot else own


def _seat(head: Head, q: np.ndarray, y_hot: list[np.ndarray], d: float, theta: float, sweep: int):
    """One sweep over a bucket's contexts: the new state, each word's tables, and the tables of contexts dealt by pair."""
    log_s = stirling(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, row in _rows(batches):
            rare, a = _found(row), load(row.column("data")[0].as_py())
            u, once, w, at, to, c, t = a[0].astype(np.int64), a[1], _long(a[2], a[3]), *(x.astype(np.int64) for x in a[4:])
            value = _at_words(w, q, rare["w"].view(np.uint64), rare["q"], 1e-12)
            rng = np.random.Generator(np.random.Philox(key=[bucket, sweep]))
            for y_all in y_hot:
                y = _totals(u, head.hot, rng.standard_gamma(theta / d + once + np.bincount(at, weights=t, minlength=len(u))), y_all)
                t = draw_tables(c, d * y[at] * value[to], d, log_s, rng)
            hot = np.flatnonzero(u < head.hot)
            tables = np.bincount(to, weights=t, minlength=len(w)).astype(np.int64)
            above = (once + np.bincount(at, weights=t, minlength=len(u)))[hot].astype(np.int64)
            n, m = len(w), len(hot)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * (n + m + 1), pa.int32()), pa.array([None, *w.view(np.int64).tolist(), *[None] * m], pa.int64()), pa.array([None] * (n + 1) + u[hot].tolist(), pa.int64()), pa.array([None, *tables.tolist(), *above.tolist()], pa.int64()), pa.array([dump(*a[:7], t)] + [None] * (n + m), pa.binary())],
                ["bucket", "w", "u", "n", "data"],
            )

    return run


def _seat_shared(x: float, d: float, sweep: int):
    """``a``: the shared restaurant's tables of each token for the ``served`` tables above it; ``g``: its gamma."""
    log_s = stirling(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            c = b.column("served").to_numpy()
            rng = np.random.Generator(np.random.Philox(key=[TaskContext.get().partitionId() << 32 | k, 1 << 32 | sweep]))
            a = draw_tables(c, np.full(len(c), x), d, log_s, rng)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a), pa.array(rng.standard_gamma(c - d * a))], [*b.schema.names, "a", "g"])

    return run


def _tidy(*paths: str, spark: SparkSession) -> None:
    """Deletes tables that are read no more, and lets Spark drop the shuffles that wrote them."""
    for p in paths:
        delete(spark, p)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass
class Model:
    """What was learnt: sizes, discounts, where each bucket's pairs and seats are, and each token's shared probabilities."""

    n: int
    v: int
    d: float
    theta: float
    head: Head
    pairs: str  # bucket, batch, ids, pairs, uses
    table: str  # the same as a table in the session's catalog, bucketed
    words: str  # w, c and for each sample q: probability in the shared restaurant (null for tokens seen once)
    seats: list[str]  # for each sample: bucket, data
    hot: list[np.ndarray]  # for each sample: the tables of contexts dealt by pair
    once: list[float]  # for each sample: the shared probability of a token seen once
    unknown: list[float]  # and of the unknown token


def learn(docs: DataFrame, *, which: Column | None = None, id_col: str = "doc_id", text_col: str = "text", burn_in: int = 1, samples: int = 2, inner: int = 2, theta: float = 1.0, bucket_tokens: int = 900_000, short_codes: int = HEAD) -> Model:
    """Learns from the whole texts of ``docs`` for which ``which`` holds (None: all), and deals all texts' pairs for :func:`score`.

    Null and empty texts are one END each; a null ``which`` is false. Without learnt rows the model knows no token:
    everything is unknown. ``inner``: draws of the contexts for each draw of the shared restaurant. ``short_codes``: how many tokens every task knows. Other columns are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(which, F.lit(False)).alias("learn") if which is not None else F.lit(True).alias("learn"), F.col(text_col).alias("text"))
    counted = count_tokens(src.filter("learn"))
    counts_at = stored(counted)
    counts = spark.read.schema(counted.schema).parquet(counts_at)
    r = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = r["n"] or 0, r["v"]
    top = counts.filter("h <> 0").orderBy(F.desc("c"), "h").limit(min(short_codes, HEAD) - 1).toArrow()  # HEAD rows at most
    ends = counts.filter("h = 0").first()
    hashes = np.concatenate([END, top["h"].to_numpy().view(np.uint64)]) if top.num_rows else END
    count_of = np.concatenate([[ends["c"] if ends else 0], top["c"].to_numpy()]) if top.num_rows else np.array([ends["c"] if ends else 0])
    order = np.argsort(hashes)
    n_buckets = max(shuffle_partitions(docs), -(-n // bucket_tokens))
    # END is code 0 whatever its count; the others come in order of counts
    hot = 1 + int((count_of[1:] > n / n_buckets / 4).sum())
    head = Head(hashes[order], order.astype(np.uint64), count_of, hot, n_buckets)
    codes = F.broadcast(spark.createDataFrame(pa.table({"h": hashes.view(np.int64), "code": np.arange(len(hashes))})))
    words_at = stored(counts.join(codes, "h", "left").select(F.coalesce("code", F.when(F.col("h").between(0, HEAD - 1), HEAD).otherwise(F.col("h"))).alias("w"), "c"))

    merged = _dealt(_packed(src, head, kind), head, "bucket", _merge, f"bucket int, batch long, ids array<{kind}>, pairs binary, uses binary, n1 long, n2 long")
    pairs_at, table = scratch(spark), f"quire_{uuid.uuid4().hex}"
    # bucketed as they are dealt, so that scoring reads them in place
    merged.write.format("parquet").bucketBy(_spread(docs, head), "bucket").sortBy("bucket").option("path", pairs_at).saveAsTable(table)
    try:
        _tidy(counts_at, spark=spark)
        return _seated(spark.read.schema(merged.schema).parquet(pairs_at).filter("bucket >= 0"), head, r, count_of, pairs_at, table, words_at, burn_in, samples, inner, theta)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise


def _seated(pairs: DataFrame, head: Head, r: Row, count_of: np.ndarray, pairs_at: str, table: str, words_at: str, burn_in: int, samples: int, inner: int, theta: float) -> Model:
    """Samples the seats of all pairs; ``r``: tokens, different tokens, those seen once and twice."""
    spark, n, v, hot = pairs.sparkSession, r["n"] or 0, r["v"], head.hot
    p = pairs.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    discount = lambda one, two: min(0.95, max(0.05, ((one or 0) + 1) / ((one or 0) + 2 * (two or 0) + 2)))
    d, d1, theta1, base = discount(p["n1"], p["n2"]), discount(r["n1"], r["n2"]), 1.0, 0.5 / max(v, 1)

    state_at = stored(pairs.select("bucket", "pairs").mapInArrow(_start, "bucket int, w long, ones long, data binary"))
    state = spark.read.parquet(state_at)
    words = spark.read.parquet(words_at)
    often = words.filter("c > 1").join(state.filter("w IS NOT NULL").groupBy("w").agg(F.sum("ones").alias("ones")), "w", "left")
    shared_at = stored(often.select("w", "c", F.coalesce("ones", F.lit(0)).alias("ones"), (F.col("c") / max(n, 1)).alias("q")))
    wanted_at = stored(state.filter("data IS NOT NULL").select("bucket", "data").mapInArrow(_wanted, "bucket int, w long"))

    driver, tables, t_hot = np.random.default_rng(11), float(v), count_of[:hot] * 0.5
    seats, hots, once, unknown = [], [], [], []
    for sweep in range(burn_in + samples):
        shared = spark.read.parquet(shared_at)
        kept = [f"q{s}" for s in range(max(0, sweep - burn_in))]
        near = shared.filter(F.col("w").between(0, HEAD - 1)).select("w", "q").toArrow()  # HEAD rows at most
        q_head = np.full(HEAD, 1e-12)
        q_head[near["w"].to_numpy()] = near["q"].to_numpy()
        found = spark.read.parquet(wanted_at).join(shared.select("w", "q"), "w")
        found = _each(found, head).groupBy("bucket").agg(F.collect_list(F.struct("w", "q")).alias("found"))  # at most as many as the bucket has words
        rows = _each(spark.read.parquet(state_at).filter("data IS NOT NULL").select("bucket", "data"), head).join(found, "bucket", "left")
        y_hot = [driver.standard_gamma(theta / d + t_hot)] * inner
        drawn_at = stored(rows.mapInArrow(_seat(head, q_head, y_hot, d, theta, sweep), "bucket int, w long, u long, n long, data binary"))
        drawn = spark.read.parquet(drawn_at)
        t_hot = np.zeros(hot)
        for x in drawn.filter("u IS NOT NULL").groupBy("u").agg(F.sum("n").alias("n")).collect():  # HEAD rows at most
            t_hot[x["u"]] = x["n"]
        above = drawn.filter("w IS NOT NULL").groupBy("w").agg(F.sum("n").alias("n"))
        held = shared.drop("q").join(above, "w", "left").withColumn("served", F.col("ones") + F.coalesce("n", F.lit(0))).drop("n")
        x1 = d1 * float(driver.standard_gamma(theta1 / d1 + tables)) * base
        tabled_at = stored(held.mapInArrow(_seat_shared(x1, d1, sweep), ", ".join(f"{c} {k}" for c, k in held.dtypes) + ", a long, g double"))
        tabled = spark.read.parquet(tabled_at)
        total = tabled.agg(F.sum("a").alias("a"), F.sum("served").alias("s"), F.sum("g").alias("g")).first()
        # tokens seen once have one customer and one table, always; the sum of their gammas is one gamma
        tables, customers = float(total["a"] or 0) + r["n1"], float(total["s"] or 0) + r["n1"]
        rest = float(driver.standard_gamma(theta1 + d1 * tables))
        mass = (total["g"] or 0.0) + rest + float(driver.standard_gamma(r["n1"] * (1 - d1)))
        left = (theta1 + d1 * tables) / (theta1 + customers)
        after = tabled.select("w", "c", "ones", *kept, ((F.col("g") + rest * base) / mass).alias("q"), *([((F.col("served") - d1 * F.col("a")) / (theta1 + customers) + left * base).cast("float").alias(f"q{sweep - burn_in}")] if sweep >= burn_in else []))
        old, shared_at = shared_at, stored(after)
        if sweep >= burn_in:
            seats.append(drawn_at)
            hots.append(t_hot)
            once.append((1 - d1) / (theta1 + customers) + left * base)
            unknown.append(left * 0.5)
        gone = [old, tabled_at] + ([state_at] if state_at not in seats else [])
        state_at = drawn_at
        del shared, found, rows, drawn, above, held, tabled, after
        _tidy(*gone, spark=spark)

    final = spark.read.parquet(shared_at)
    per = [f"q{s}" for s in range(samples)]
    words_to = stored(final.select("w", "c", *per).unionByName(spark.read.parquet(words_at).filter("c = 1").select("w", "c", *[F.lit(None).cast("float").alias(x) for x in per])))
    del final
    _tidy(words_at, shared_at, wanted_at, spark=spark)
    return Model(n, v, d, theta, head, pairs_at, table, words_to, seats, hots, once, unknown)


def probabilities(m: Model, pairs: bytes, seats: list[bytes], q_head: list[np.ndarray], c_head: np.ndarray, rare: np.ndarray, c_rare: np.ndarray, q_rare: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of a bucket: the predictive probability, averaged over samples; its word's count; its context (in the bucket)."""
    u, w, at, to, c = _pairs(pairs)
    cw = _at_words(w, c_head, rare, c_rare, 0.0)
    cu = _totals(u, m.head.hot, np.bincount(at, weights=c, minlength=len(u)), m.head.counts)
    p, many = np.zeros(len(c)), c > 1
    for s, data in enumerate(seats):
        t = np.minimum(c, 1).astype(np.float64)
        t[many] = load(data)[7]
        tu = _totals(u, m.head.hot, np.bincount(at, weights=t, minlength=len(u)), m.hot[s])
        q = np.where(cw > 1, _at_words(w, q_head[s], rare, q_rare[s], 0.0), np.where(cw > 0, m.once[s], m.unknown[s]))
        down = np.where(cu > 0, (m.theta + m.d * tu) / (m.theta + cu), 1.0)
        p += down[at] * q[to]
        t *= -m.d
        t += c
        t /= m.theta + cu[at]
        p += t
    return p / max(len(seats), 1), cw[to], at


def _scores(m: Model, q_head: list[np.ndarray], c_head: np.ndarray, ids: pa.DataType):
    """What each bucket adds to each text of each block: known tokens, base score, score."""
    floor, k = float(np.log10(m.n + m.v + 1)), len(m.seats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row in _rows(batches):
            blob = lambda c: row.column(c)[0].as_py()  # noqa: E731, B023
            rare = _found(row)
            p, cw, _ = probabilities(m, blob("pairs"), [blob(f"seats{s}") for s in range(k)], q_head, c_head, rare["w"].view(np.uint64), rare["c"].astype(float), [np.nan_to_num(rare[f"q{s}"].astype(float)) for s in range(k)])
            log_p, base, known = np.log10(p), np.log10(cw + 1) - floor, cw > 0
            del p, cw, rare
            batch, sizes, step, n_docs, uses, doc, times = load(blob("uses"))
            i = j = 0
            out = []
            for size, use in zip(sizes.tolist(), uses.tolist(), strict=True):
                to = np.repeat(np.cumsum(step[i : i + size], dtype=np.int64), n_docs[i : i + size])
                docs, many = doc[j : j + use].astype(np.int64), times[j : j + use]
                sums = [np.bincount(docs, weights=many * x[to]) for x in (known, base, log_p)]
                some = np.flatnonzero(np.bincount(docs))
                out.append(dump(some, sums[0][some].astype(np.int64), sums[1][some], sums[2][some]))
                i, j = i + size, j + use
            yield pa.RecordBatch.from_arrays([pa.array(batch.astype(np.int64)), pa.nulls(len(out), ids), pa.array(out, pa.binary())], ["batch", "ids", "data"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's sums over all buckets."""
    for _, rows in _groups(batches):
        ids, parts = rows.column(1), [load(x.as_py()) for x in rows.column(2)]
        here = int(np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))[0])
        sizes = parts[here][0].astype(np.int64)
        sums = [np.zeros(len(sizes)) for _ in range(3)]
        for k in sorted((k for k in range(len(parts)) if k != here), key=lambda k: parts[k][3].tobytes()):  # always in the same order
            for total, x in zip(sums, parts[k][1:], strict=True):
                total[parts[k][0]] += x
        yield pa.RecordBatch.from_arrays([ids[here].values, pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(spark: SparkSession, m: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10 probabilities) and ``perplexity`` of every row that :func:`learn` was given.

    Rows are scored one by one, those of one id too. Null and empty texts are the END token alone.
    """
    k = len(m.seats)
    pairs, words = spark.read.schema(spark.table(m.table).schema).parquet(m.pairs), spark.read.parquet(m.words)
    kind = pairs.schema["ids"].dataType.simpleString()
    near = words.filter(F.col("w").between(0, HEAD - 1)).toArrow()  # HEAD rows at most
    c_head, q_head = np.zeros(HEAD), [np.zeros(HEAD) for _ in range(k)]
    c_head[near["w"].to_numpy()] = near["c"].to_numpy()
    for s in range(k):
        q_head[s][near["w"].to_numpy()] = np.nan_to_num(near[f"q{s}"].to_numpy().astype(float))
    buckets = pairs.filter("bucket >= 0")
    wanted = buckets.select("bucket", "pairs").mapInArrow(_wanted, "bucket int, w long")
    found = _each(wanted.join(words, "w"), m.head).groupBy("bucket").agg(F.collect_list(F.struct("w", "c", *[f"q{s}" for s in range(k)])).alias("found"))  # at most as many as the bucket has words
    rows = spark.table(m.table).filter("bucket >= 0").select("bucket", "pairs", "uses").join(found, "bucket", "left")
    for s, path in enumerate(m.seats):
        rows = rows.join(_each(spark.read.parquet(path).filter("data IS NOT NULL").select("bucket", F.col("data").alias(f"seats{s}")), m.head), "bucket")
    parts = rows.mapInArrow(_scores(m, q_head, c_head, to_arrow_type(pairs.schema["ids"].dataType)), f"batch long, ids {kind}, data binary")
    parts = parts.unionByName(pairs.filter("bucket < 0").select("batch", "ids", F.col("pairs").alias("data")))
    out = _dealt(parts, m.head, "batch", _added, f"doc_id {kind[6:-1]}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def forget(spark: SparkSession, m: Model) -> None:
    """Deletes the model's tables."""
    spark.sql(f"DROP TABLE IF EXISTS {m.table}")
    _tidy(m.pairs, m.words, *m.seats, spark=spark)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learnt outside the held-out fold, all documents scored."""
    held, spark = crc_fold(F.col("doc_id"), 7) == 2, docs.sparkSession
    with small_batches(spark):
        m = learn(docs, which=~held)
        try:
            out = materialize(score(spark, m))
        finally:
            forget(spark, m)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
