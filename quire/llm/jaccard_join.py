"""N-gram Jaccard join: which texts have word shingles in common beyond a threshold, exactly, by signature trees.

Sets are hashed shingles; equal sets are one node. Two sets of a Jaccard similarity t share one of the first
n - ceil(t * n) + 1 tokens of either under any one order of tokens; here rarer tokens come first, by counts over all
texts in a fixed number of hash buckets, so common passages hardly meet. Nodes that share such a token are a block.

1. Blocks of nodes' prefix tokens (16 bytes a token); blocks with the same members count once.
2. Members of a block whose size is near no other's go. In each block a signature tree finds the pairs that bitmaps and sizes allow; they join nodes into coarse groups, which
   contain every true component.
3. Each group's texts meet once, and a signature tree over them decides pairs by their sets.
4. Connected components of the true links.

Blocks and groups beyond a bound on members or weight are cut into chunks, and no task holds more than two of them. Chunks
are linked inside; then one member of each component of each chunk meets those of the others; then only pairs of members
that are still apart meet: those outside the group's largest component among each other and with it (``_settle``).

A node pair is skipped only where its sets are in one component already, so no component is split and none is merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SMALL, boxed, materialize, shuffle_partitions
from quire.llm.components import components
from quire.llm.signature_tree import bitmap, common, link, link_any, width
from quire.llm.words import bounds, mix, runs, shingles, with_ids

#: Hash buckets whose counts order the tokens: 1 MB whatever the corpus.
BUCKETS = 1 << 18
#: Bounds on a chunk of texts: sets, and tokens; and on one of bitmaps: sets, and bytes.
MEMBERS, TOKENS = 1000, 4_000_000
BLOCK, BITMAPS = 20_000, 64_000_000


def _node(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` (hash of the set, null for an empty one), ``sig`` (its bitmap), ``counts`` null.

    And a row for each task with nothing but ``counts``: how many of its shingles fall into each bucket, 4 bytes each.
    """
    names = ["doc_id", "n_shingles", "node", "sig", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for ids, texts in ((ids, texts) for b in batches for ids, texts in with_ids(b)):
            sets = [shingles(t, n) for t in texts]
            total += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s, width(len(s))).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, *cols, pa.nulls(len(sets), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node binary, sig binary, counts binary")


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for c in b.column(0).to_pylist():
                total += np.frombuffer(c, dtype=np.uint32)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "c"])

    tasks = rows.filter(F.col("counts").isNotNull()).select("counts")
    # a task adds up hundreds of these rows, so that what shuffles is far less than they are
    got = tasks.coalesce(max(8, tasks.count() // 256)).mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if got.num_rows:
        counts[got["bucket"].to_numpy()] = got["c"].to_numpy()
    return counts


def _prefixes(docs: DataFrame, bucket_counts: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """``token``, ``id`` (first half of the node) for the prefix tokens of each node, once in a batch."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = counts.value
        for b in batches:
            ids, tokens, seen = [], [], set()
            for t in b.column(0).to_pylist():
                s = shingles(t, n)
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                k = len(s) - (num * len(s) + den - 1) // den + 1
                tokens.append(s[np.lexsort((s, weight[(s % np.uint64(BUCKETS)).astype(np.int64)]))[:k]])
                ids.append(np.full(k, int.from_bytes(node[:8], "little", signed=True), dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], ["token", "id"])

    return docs.select("text").mapInArrow(run, "token long, id long")


def _blocks(prefixes: DataFrame) -> DataFrame:
    """``block``, ``id``: the members of every block of two nodes or more. Blocks are named by their members, so equal ones merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in runs(batches):
            token, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.append(True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]))
            token, ids = token[new], ids[new]
            at = bounds([token])
            size = np.diff(at)
            name = np.add.reduceat(mix(ids.view(np.uint64)), at[:-1]).view(np.int64)
            fresh = np.zeros(len(size), dtype=bool)
            for i in np.flatnonzero(size > 1).tolist():
                if (x := int(name[i])) not in seen:
                    fresh[i] = True
                    if len(seen) < 1_000_000:
                        seen.add(x)
            keep = np.repeat(fresh, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep]), pa.array(ids[keep])], ["block", "id"])

    n = shuffle_partitions(prefixes)
    return prefixes.repartition(n, "token").sortWithinPartitions("token", "id").mapInArrow(run, "block long, id long")


def _settle(members: DataFrame, compare: Callable[[DataFrame], DataFrame], most: int, heaviest: int) -> DataFrame:
    """``a``, ``b``: links that join the members (``grp``, ``rep``, weight ``w``; written) of each group into its components.

    ``compare`` gives the links among rows that share ``grp``, ``x`` and ``y``; it need not compare members of equal
    ``known``. Groups of up to ``most`` members and weight ``heaviest`` are one call. Larger ones are cut: chunks alone,
    then the components' first members, then every pair of members that no link has joined, chunk by chunk.
    """
    cut = lambda n, w: F.greatest(F.ceil(n / most), F.ceil(w / heaviest), F.lit(1)).cast("int")
    size = [F.count("*").alias("n"), F.sum("w").alias("w")]
    deal = lambda k, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(k)).cast("int")
    alone = lambda df, seed: df.withColumn("x", deal("k", seed)).select("grp", "x", F.col("x").alias("y"), "rep", "known")

    large = materialize(members.groupBy("grp").agg(*size).select("grp", cut(F.col("n"), F.col("w")).alias("k")).filter("k > 1"))
    n_large = large.count()
    first = members.withColumn("known", F.col("rep"))
    if not n_large:
        return compare(first.select("grp", F.lit(0).alias("x"), F.lit(0).alias("y"), "rep", "known"))
    few = F.broadcast(large) if n_large <= SMALL else large
    links = materialize(compare(alone(first.join(few, "grp", "left").withColumn("k", F.coalesce("k", F.lit(1))), 0)))

    cuts = materialize(members.join(few, "grp"))
    joined = lambda: cuts.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("known", F.coalesce("component", "rep")).drop("component")
    heads = materialize(joined().groupBy("grp", "known", deal("k", 0).alias("at")).agg(F.min_by("w", "rep").alias("w"), F.min("rep").alias("rep")))
    parts = heads.groupBy("grp").agg(*size).select("grp", cut(F.col("n"), F.col("w")).alias("k"))
    links = materialize(links.unionByName(compare(alone(heads.join(parts, "grp"), 1))))

    apart = materialize(joined().drop("k"))
    by = apart.groupBy("grp", "known").agg(*size)
    top = by.groupBy("grp").agg(F.max(F.struct("n", "w", "known")).alias("t"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).filter("parts > 1")
    top = top.select("grp", F.col("t.known").alias("major"), cut(F.col("n") - F.col("t.n"), F.col("w") - F.col("t.w")).alias("m"), cut(F.col("t.n"), F.col("t.w")).alias("l"))
    rows = apart.join(top, "grp").withColumn("minor", F.col("known") != F.col("major"))
    rows = rows.withColumn("q", F.when(F.col("minor"), deal("m", 2)).otherwise(F.col("m") + deal("l", 2)))
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1 + F.when(F.col("minor"), F.col("l")).otherwise(0))))
    return links.unionByName(compare(rows.select("grp", F.least("q", "p").alias("x"), F.greatest("q", "p").alias("y"), "rep", "known")))


def _coarse(blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b``: links between the reps of nodes that bitmaps and sizes allow, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 3):
            grp, x, y, rep, known, n = (b.column(i).to_numpy() for i in range(6))
            sig, out = b.column(6).to_pylist(), []
            at = bounds([grp, x, y])
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                out += [(rep[i + p], rep[i + q]) for p, q in link_any(n[i:j], sig[i:j], num, den, known[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    def compare(dealt: DataFrame) -> DataFrame:
        met = dealt.join(sets.select("rep", "n_shingles", "sig"), "rep").select("grp", "x", "y", "rep", "known", "n_shingles", "sig")
        return met.repartition(shuffle_partitions(blocks), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "rep").mapInArrow(run, "a long, b long")

    met = blocks.join(sets.select("id", "rep", "n_shingles", F.length("sig").alias("w")), "id").repartition(shuffle_partitions(blocks), "block")
    members = met.groupBy(F.col("block").alias("grp"), "rep").agg(F.max("w").alias("w"), F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    # members whose size no other one of the block comes near link with none there; what stays has a neighbour in size
    by = W.partitionBy("grp").orderBy("lo")
    near = (F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)) * den >= F.col("lo") * num) | (F.lead("lo").over(by) * num <= F.col("hi") * den)
    return _settle(materialize(members.withColumn("near", near).filter("near").select("grp", "rep", "w")), compare, BLOCK, BITMAPS)


def _exact(docs: DataFrame, grouped: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``a``, ``b``: true links that join the members (``rep``, ``node``, ``n_shingles``, ``component``) of each coarse group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 3):
            at, out = bounds([b.column(i).to_numpy() for i in range(3)]), []
            rep, known, node, text = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5), b.column(6)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                kept, sets, last = [], [], None
                for k in range(i, j):
                    if (me := (rep[k], node[k].as_py())) != last and _node(s := shingles(text[k].as_py(), n)) == me[1]:
                        kept.append(k)
                        sets.append(s)
                        last = me
                if len(sets) < 2:
                    continue

                def linked(p: int, q: int, sets: list = sets) -> bool:
                    both = common(sets[p], sets[q])
                    return both * den >= num * (len(sets[p]) + len(sets[q]) - both)

                bits = 2 * width(max(len(s) for s in sets))
                sig = np.stack([bitmap(s, bits) for s in sets])
                out += [(int(rep[kept[p]]), int(rep[kept[q]])) for p, q in link(np.array([len(s) for s in sets]), sig, num, den, linked, known[kept])]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    def compare(dealt: DataFrame) -> DataFrame:
        # a rep of several sets (rows of one id) brings each of them
        dealt = materialize(dealt.join(grouped.select("rep", "node").distinct(), "rep"))
        if dealt.count() <= SMALL:
            dealt = F.broadcast(dealt)
        texts = docs.join(dealt, F.col("doc_id") == F.col("rep")).select("grp", "x", "y", "rep", "known", "node", "text")
        return texts.repartition(shuffle_partitions(docs), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "rep", "node").mapInArrow(run, "a long, b long")

    members = grouped.groupBy(F.col("component").alias("grp"), "rep").agg(F.sum("n_shingles").alias("w"))
    return _settle(materialize(members), compare, MEMBERS, TOKENS)


def jaccard_components(docs: DataFrame, *, n: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach, for every row.

    Texts link when den * shared >= num * united shingles of ``n`` words. Ids are whole numbers. A text of fewer words is one
    shingle; null texts and texts without words have none and link with nothing. Rows of one id are one document: what
    any of them links to is in its component. Rows with a null id link with nothing and have no component. Other columns
    are dropped, whatever their names. An empty table gives an empty one.

    Two passes over the texts hash their words; texts shuffle at most once, those of groups only where the groups are few
    enough to be broadcast (a checked count). Set hashes of 128 bits find equal sets; whatever else is hashed decides which
    texts are compared and not how.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_nodes(docs, n))
    counts, rows = _bucket_counts(rows), rows.filter(F.col("counts").isNull()).drop("counts")
    docs = docs.filter(F.col("doc_id").isNotNull())
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    # the first 8 bytes of a node, read as a little-endian number
    low = F.concat(*[F.substring(F.hex("node"), 2 * i + 1, 2) for i in range(7, -1, -1)])
    sets = known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sets = materialize(sets.withColumn("id", F.conv(low, 16, -10).cast("long")))

    coarse = components(_coarse(_blocks(_prefixes(docs, counts, n, num, den)), sets, num, den))
    grouped = materialize(coarse.withColumnRenamed("node", "rep").join(sets.select("rep", "node", "n_shingles"), "rep"))
    copies = known.join(sets.select("node", "rep"), "node").filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(_exact(docs, grouped, n, num, den).unionByName(copies))
    out = rows.select("doc_id", "n_shingles").join(joined, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without near copies: of each component the document of the smallest id stays, and rows with a null id.

    All columns are kept. Ids to drop are broadcast where a count shows them to be few; else texts shuffle once more.
    """
    found = jaccard_components(docs, **how)
    id_col = how.get("id_col", "doc_id")
    drop = materialize(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("drop")).distinct())
    if drop.count() <= SMALL:
        drop = F.broadcast(drop)
    return boxed(docs, id=F.col(id_col).cast("long")).join(drop, F.col("id") == F.col("drop"), "left_anti").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return jaccard_components(docs)
