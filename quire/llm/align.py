"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which tokens of another.

Tokenizer A is a ``tokenizers`` byte-level BPE that encodes space + text, B a ``sentencepiece`` BPE that adds the space itself.
The character offsets that A reports and the byte spans that B reports are coarse cuts: a token whose end is also the next
one's begin ends there. Tokens between two such cuts (parts of a multibyte character, byte-fallback tokens) end where the
bytes that their entries decode to end. Offsets where tokens of both end cut a text into groups.

Both tokenizers end their tokens before a space that follows no space, so a text is taken apart at those (:data:`CUT`); each worker
aligns a chunk once, many chunks with one call, and numpy gathers what the occurrences add up to. A pair of tokenizers for
which that is not so (an entry of B with a space after something else, A without its pattern) aligns whole texts.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import delete, scratch, small_batches
from quire.llm.words import slices

#: The space that begins a chunk, which it keeps; B gives none for a space alone.
CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
#: Chunks after which a worker's table begins anew.
KEEP = 300_000
#: Chunks that one call encodes.
TOGETHER = 20_000
#: Pairs of the corpus that are broadcast at once (13 bytes each); more take several passes over the written links.
PAIRS = 4_000_000

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def default_paths() -> tuple[str, str]:
    """A and B among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """Character to byte in byte-level entries: visible Latin-1 characters are themselves, other bytes count on from U+0100."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of n."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _ends(clean: np.ndarray, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where tokens end: at their cut, or as many bytes after the last cut before them as they and those between decode to."""
    so_far = np.cumsum(size)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(clean)), -1))
    at, known = np.where(last >= 0, cut[last], 0), np.where(last >= 0, so_far[last], 0)
    return at + so_far - known


class Aligner:
    """Groups of chunks, and a table of those seen before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        made, byte, vocab = json.loads(self.a.to_str()), _byte_of(), self.a.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in made["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = t.encode() if t in added else bytes(byte[c] for c in t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        how = made["pre_tokenizer"] or {}
        self.by_chunk = made["normalizer"] is None and how.get("type") == "ByteLevel" and how.get("use_regex", True) and not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.n_b = len(pieces)
        #: Pairs are numbers, first id * n_b + second id; their differences in ascending order are written in so many bytes.
        self.kind = "<u4" if len(self.a_bytes) * self.n_b <= 1 << 32 else "<u8"
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), self.n_b))]
        self.digits = np.frombuffer(b"".join(x.ljust(8) for x in digits), dtype=np.uint8).reshape(-1, 8)
        self.digit_n = np.array([len(x) for x in digits])
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.count = np.zeros((0, 5), dtype=np.int64)  # tokens of A, of B, groups, links, 1 if the bytes differ
        self.first = np.zeros(0, dtype=np.int64)  # of a chunk's links
        self.links = np.zeros(0, dtype=np.int64)
        self.said: list[str] = []

    def _of_a(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        got = self.a.encode(text, add_special_tokens=False)
        ids = got.ids
        if b"".join([self.a_bytes[i] for i in ids]) != raw:
            return None
        at = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
        if len(raw) == len(text):
            cut = at[:, 1]
        else:
            code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            cut = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])[at[:, 1]]
        ids = np.array(ids, dtype=np.int64)
        return ids, _ends(at[:, 1] <= np.append(at[1:, 0], at[-1:, 1]), cut, self.a_size[ids])

    def _of_b(self, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        got = self.b.encode(raw[1:], return_type="offset_mapping")  # the spans of its proto, in bytes
        ids = got["ids"]
        if b"".join([self.b_bytes[i] for i in ids]) != raw:
            return None
        at = np.array(got["offsets"], dtype=np.int64).reshape(-1, 2)
        ids = np.array(ids, dtype=np.int64)
        clean = (at[:, 1] <= np.append(at[1:, 0], at[-1:, 1])) & (at[:, 1] > at[:, 0])
        return ids, _ends(clean, at[:, 1] + 1, self.b_size[ids])

    def _learn(self, chunks: list[str]) -> None:
        """Aligns new chunks and puts them into the table, all with one call if that gives what each alone gives."""
        text = "".join(chunks)
        raw = text.encode("utf-8", "surrogatepass")
        a, b = self._of_a(text, raw), self._of_b(raw)
        stop = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in chunks]) if len(raw) > len(text) else np.cumsum([len(c) for c in chunks])
        if a and b:
            common = np.intersect1d(a[1], b[1], assume_unique=True)
            last = np.minimum(np.searchsorted(common, stop), len(common) - 1)
            if (common[last] == stop).all():
                return self._keep(chunks, a, b, common, last)
        if len(chunks) > 1:
            half = len(chunks) // 2
            self._learn(chunks[:half])
            return self._learn(chunks[half:])
        self.row[chunks[0]] = len(self.said)
        self.said.append("")
        self.count = np.vstack([self.count, [[0, 0, 0, 0, 1]]])
        self.first = np.append(self.first, len(self.links))
        return None

    def _keep(self, chunks: list[str], a: tuple, b: tuple, common: np.ndarray, last: np.ndarray) -> None:
        ga, gb = np.searchsorted(common, a[1]), np.searchsorted(common, b[1])
        na, nb = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
        of = np.searchsorted(last, np.arange(len(common)))  # the chunk of each group
        per = np.array([np.bincount(of, weights=x, minlength=len(chunks)) for x in (na, nb, np.ones(len(common)), na * nb)], dtype=np.int64).T
        fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
        one = np.repeat(np.arange(len(a[0])), nb[ga])  # each token of A, once for each token of B in its group
        links = a[0][one] * self.n_b + b[0][_expand(fb[ga], nb[ga])]
        # What a group says: its tokens of A, a bar, its tokens of B, each after a mark.
        place_a, place_b = np.arange(len(a[0])) + fb[ga], np.arange(len(b[0])) + (fa + na)[gb]
        ids, mark = np.empty(len(a[0]) + len(b[0]), dtype=np.int64), np.full(len(a[0]) + len(b[0]), ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = a[0], b[0]
        mark[place_a[fa]], mark[place_b[fb]] = ord(";"), ord("|")
        n = self.digit_n[ids] + 1
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.uint8)
        out[at] = mark
        flat = self.digits.ravel()
        out[_expand(at + 1, n - 1)] = flat[_expand(ids * 8, n - 1)]
        begins = np.append(at[place_a[fa[np.append(0, last[:-1] + 1)]]], len(out)).tolist()
        said = out.tobytes().decode()
        self.row.update(zip(chunks, range(len(self.said), len(self.said) + len(chunks)), strict=True))
        self.said += [said[x + 1 : y] for x, y in zip(begins[:-1], begins[1:], strict=True)]
        self.first = np.append(self.first, len(self.links) + np.cumsum(per[:, 3]) - per[:, 3])
        self.links = np.append(self.links, links)
        self.count = np.vstack([self.count, np.column_stack([per, np.zeros(len(chunks), dtype=np.int64)])])

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The table's rows of different chunks."""
        if len(self.said) > KEEP:
            self.forget()
        new = [c for c in chunks if c not in self.row]
        joined, alone = [], []
        for c in new:  # white space at an end could run into the next chunk's
            (joined if self.by_chunk and not c[1:2].isspace() and not c[-1].isspace() else alone).append(c)
        for i in range(0, len(joined), TOGETHER):
            self._learn(joined[i : i + TOGETHER])
        for c in alone:
            self._learn([c])
        return np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def chunks(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different chunks, which of them each occurrence is, and the occurrences of each text; none of an empty text."""
        full = pc.greater(pc.binary_length(texts), 0)
        if self.by_chunk:
            lists = pc.split_pattern(texts, " ")
            code = lists.flatten().dictionary_encode()
            d = code.dictionary
            odd = pc.or_(pc.equal(d, ""), pc.not_equal(pc.utf8_rtrim_whitespace(d), d)).to_numpy(zero_copy_only=False)
            at, n = code.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
            if not odd.any():
                return [" " + x for x in d.to_pylist()], at, n
            lists = [CUT.split(x) if x else [] for x in texts.to_pylist()]
        else:
            lists = [[x] if f else [] for x, f in zip(texts.to_pylist(), full.to_pylist(), strict=True)]
        number: dict[str, int] = {}
        at = np.array([number.setdefault(" " + p, len(number)) for x in lists for p in x], dtype=np.int64)
        return list(number), at, np.array([len(x) for x in lists], dtype=np.int64)

    def align(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """One row for each text, as :data:`ALIGNED` says."""
        chunks, at, n = self.chunks(pc.fill_null(texts, ""))
        at = self.rows(chunks)[at] if len(chunks) else at
        doc = np.repeat(np.arange(len(n)), n)
        sums = [np.bincount(doc, weights=self.count[at, k], minlength=len(n)).astype(np.int64) for k in range(5)]
        bad = sums[4] > 0
        sums = [np.where(bad, 0, x) for x in sums[:4]]
        row, stop = at.tolist(), np.cumsum(n).tolist()
        groups = ["" if b else ";".join(map(self.said.__getitem__, row[i:j])) for i, j, b in zip([0, *stop[:-1]], stop, bad.tolist(), strict=True)]
        # The different chunks of each text with their numbers, then its different pairs.
        if len(self.said):
            own, m = np.unique((doc * len(self.said) + at)[~bad[doc]], return_counts=True)
            d, r = own // len(self.said), own % len(self.said)
        else:
            d = r = m = np.zeros(0, dtype=np.int64)
        k = self.count[r, 3]
        size = len(self.a_bytes) * self.n_b
        pair = np.repeat(d, k) * size + self.links[_expand(self.first[r], k)]
        order = np.argsort(pair)
        pair, m = pair[order], np.repeat(m, k)[order]
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
        m, pair = np.add.reduceat(m, begin) if len(begin) else m, pair[begin]
        d, pair = pair // size, pair % size
        gap = np.diff(pair, prepend=0)
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, dtype=np.int64)
        gap[first] = pair[first]
        width = np.dtype(self.kind).itemsize
        ends = np.append(0, np.cumsum(np.bincount(d, minlength=len(n))))
        cut = lambda x, w: [x[i * w : j * w] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, *[pa.array(x, pa.int64()) for x in sums], pa.array(groups, pa.string()), pa.array(cut(gap.astype(self.kind).tobytes(), width), pa.binary()), pa.array(cut(m.astype("<u4").tobytes(), 4), pa.binary())],
            names=[x.split()[0] for x in ALIGNED.split(", ")],
        )


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner, kept from task to task."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's groups, as ``a1,a2|b1;a3|b2,b3``, with numbers of tokens, groups and links (pairs of tokens whose bytes share a group).

    ``pairs`` has the different id pairs of the links, ascending, as differences in little-endian unsigned integers (a pair is a
    number: first id times the size of B plus second id), ``times`` how often each occurs. Texts that are null, empty, or not
    the bytes that A's or B's tokens decode to have zeros and an empty string. One row for each row of ``docs``, null ids and
    repeated rows too; an empty table gives none. Columns but those two are not read, so no name can clash.
    """
    a, b = (path_a or default_paths()[0]), (path_b or default_paths()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                yield own.align(batch.column(0).slice(at, len(part)), part)

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(run, ALIGNED)


def _decoded(gaps: pa.Array, times: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of all rows one after the other, and the row of each."""
    n = pc.binary_length(times).to_numpy(zero_copy_only=False) // 4
    gap = np.frombuffer(b"".join(gaps.to_pylist()), dtype=kind).astype(np.int64)
    run = np.cumsum(gap)
    first = np.cumsum(n) - n
    before = np.where(first > 0, run[np.maximum(first - 1, 0)] if len(run) else 0, 0)
    return run - np.repeat(before, n), np.frombuffer(b"".join(times.to_pylist()), dtype="<u4").astype(np.int64), np.repeat(np.arange(len(n)), n)


def _counted(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    k, n = k[order], n[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[begin], np.add.reduceat(n, begin) if len(begin) else n


def pair_counts(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """How many rows of ``aligned`` hold each pair linked: ``pair``, ``a``, ``b``, ``n``, and ``best``, whether no pair of that first id has more.

    Tasks add up their own rows before they send a pair once.
    """
    pa_, pb = (path_a or default_paths()[0]), (path_b or default_paths()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = aligner(pa_, pb).kind
        held, waiting, size = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), [], 0

        def out(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(k), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 500_000]), pa.array(n[i : i + 500_000])], names=["pair", "n"])

        for batch in batches:
            pair = _decoded(batch.column(0), batch.column(1), kind)[0]
            waiting.append(pair)
            size += len(pair)
            if size > 2_000_000:
                held = _counted(np.concatenate([held[0], *waiting]), np.concatenate([held[1], np.ones(size, dtype=np.int64)]))
                waiting, size = [], 0
                if len(held[0]) > 4_000_000:
                    yield from out(*held)
                    held = (held[0][:0], held[1][:0])
        yield from out(*_counted(np.concatenate([held[0], *waiting]), np.concatenate([held[1], np.ones(size, dtype=np.int64)])))

    n_b = aligner(pa_, pb).n_b
    with small_batches(aligned.sparkSession):
        pairs = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.withColumn("a", (F.col("pair") / n_b).cast("long")).withColumn("b", F.col("pair") % n_b)
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return pairs.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_scores(aligned: DataFrame, pairs: DataFrame, at_once: int = PAIRS, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Adds to each row of ``aligned``: ``n_best``, its links whose pair is ``best``, and ``count_sum``, the sum of ``n`` over its links.

    ``aligned`` and ``pairs`` are written tables. Pairs are broadcast in ranges of at most ``at_once``, one pass over the rows
    for each; beyond one range, a row's sums are added up by its number.
    """
    spark, n = aligned.sparkSession, pairs.count()
    kind = aligner(path_a or default_paths()[0], path_b or default_paths()[1]).kind
    cols = [c for c in aligned.columns if c not in ("pairs", "times")]
    edges = [None, None]
    if n > at_once:
        k = -(-5 * n // (4 * at_once)) + 1
        edges = [None, *sorted({int(x) for x in pairs.approxQuantile("pair", [i / k for i in range(1, k)], 0.1 / k)}), None]
        aligned = aligned.withColumn("row", F.monotonically_increasing_id())
        cols = [*cols, "row"]
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = pairs.filter((F.lit(True) if low is None else F.col("pair") >= low) & (F.lit(True) if high is None else F.col("pair") < high))
        got = own.select("pair", "n", "best").toArrow()
        key, count, best = (got.column(i).to_numpy() for i in range(3))
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], count[order], best[order].astype(bool)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            key, count, best = sent.value
            for batch in batches:
                pair, times, row = _decoded(batch.column("pairs"), batch.column("times"), kind)
                if len(key):
                    at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
                    times = np.where(key[at] == pair, times, 0)
                else:
                    at, count, best, times = np.zeros(len(pair), dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=bool), times * 0
                stop = np.cumsum(np.bincount(row, minlength=batch.num_rows))
                sums = [np.diff(np.append(0, np.cumsum(times * x[at]))[stop], prepend=0) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], *[pa.array(x) for x in sums]], names=[*cols, "n_best", "count_sum"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*cols).schema) + ", n_best long, count_sum long"
        parts.append(aligned.select(*cols, "pairs", "times").mapInArrow(run, schema))
    if len(parts) == 1:
        return parts[0]
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.groupBy("row").agg(*[F.first(c).alias(c) for c in cols if c != "row"], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: numbers of tokens, groups and links, the links that are their first id's most common, the sum of their counts, and a hash of the groups."""
    spark = docs.sparkSession
    at, pairs_at = scratch(spark), scratch(spark)
    with small_batches(spark):
        said = align(docs).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
        said.write.option("compression", "zstd").parquet(at)
        aligned = spark.read.schema(said.schema).parquet(at)
        pairs = pair_counts(aligned)
        pairs.write.option("compression", "zstd").parquet(pairs_at)
        out = with_scores(aligned, spark.read.schema(pairs.schema).parquet(pairs_at))
    delete(spark, pairs_at)
    return out
