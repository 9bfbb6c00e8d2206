"""Spelling variants: which words of a corpus differ by one character, and which form of them is the usual one.

Words are counted by Spark. Their neighbourhoods are found without pairs of all words: each word's generated edits (one character
deleted, or replaced by one that sorts after it; an inserted one is a deletion seen from the other side) are probed against
blocked Bloom filters of the vocabulary, one for each length. A filter's block is one row of an aggregation, so filters are
built where the words are; the driver gets two bytes a word, in ranges of bounded size, and sends them to all tasks. Only edits that a
filter knows are written out, and a join with the vocabulary removes those that are no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SMALL, delete, lower_ascii, materialize, stored
from quire.llm.words import mix

#: A block is 256 bits for about 16 words; a word sets as many bits of it as this.
BITS = 6
#: Blocks of 32 bytes that are sent to tasks at once; a larger vocabulary takes several passes.
BLOCKS = 2_000_000
#: Candidates that a task hashes at once.
TOGETHER = 1_000_000

_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_BACK = pow(_BASE, -1, 1 << 64)


def runs_of(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lower-cased runs of letters of each text with at least ``min_chars`` characters, one row for each: ``id`` (empty for null), ``run``."""
    text = lower_ascii(docs[f"`{text_col}`"])
    found = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    return docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def word_counts(docs: DataFrame, min_chars: int = 6, min_n: int = 5, drop_one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of letters with how often they occur, those of at least ``min_chars`` characters and ``min_n`` occurrences.

    One run in ``drop_one_in``, by a checksum of its document's id and itself, loses a character: misspellings whose true form is known.
    """
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % drop_one_in == 0, short).otherwise(F.col("run"))
    counted = runs_of(docs, min_chars, id_col, text_col).withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= min_chars)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each character; a word's hash is their sum, each times a power of its place."""
    return mix(codes.astype(np.uint64) + np.uint64(0x51ED27))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of equal length: the length, their rows, and a matrix of their characters."""
    texts = words.to_pylist()
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    start = np.cumsum(n) - n
    for k in np.unique(n).tolist():
        rows = np.flatnonzero(n == k)
        yield k, rows, flat[start[rows][:, None] + np.arange(k)]


class Shards:
    """Where the filters of the lengths lie: each has so many blocks of one row of blocks."""

    def __init__(self, words_of: dict[int, int]):
        self.n = {k: -(-v // 16) for k, v in words_of.items()}
        ends = np.cumsum(list(self.n.values())).tolist() if self.n else []
        self.first = dict(zip(self.n, [0, *ends[:-1]], strict=True)) if ends else {}
        self.blocks = ends[-1] if ends else 0

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash of words of this length, and 48 bits that name its bits there."""
        h = mix(h)
        return (self.first[length] + (h % np.uint64(self.n[length])).astype(np.int64)), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def filter_blocks(vocab: DataFrame, shards: Shards) -> DataFrame:
    """The blocks of all filters: ``block`` and its four words of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, m in _by_length(batch.column(0)):
                block, which = shards.place(k, (_values(m) * _powers(k)).sum(axis=1, dtype=np.uint64))
                bits = np.zeros((len(block), 4), dtype=np.uint64)
                for i in range(BITS):
                    b = (which >> np.uint64(8 * i)) & np.uint64(255)
                    bits[np.arange(len(b)), (b >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (b & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(bits[:, i].copy().view(np.int64)) for i in range(4)]], names=["block", "b0", "b1", "b2", "b3"])

    made = vocab.select("word").mapInArrow(run, "block long, b0 long, b1 long, b2 long, b3 long")
    return made.groupBy("block").agg(*[F.expr(f"bit_or(b{i})").alias(f"b{i}") for i in range(4)])


def _edits(k: int, m: np.ndarray, alphabet: np.ndarray, shards: Shards) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length: the length of the edited word, the word's row, the place, the new character (0: deleted) and the hash."""
    power, v = _powers(k), _values(m)
    part = v * power
    total = part.sum(axis=1, dtype=np.uint64)
    if k - 1 in shards.n:
        before = np.cumsum(part, axis=1, dtype=np.uint64)
        h = before - part + (total[:, None] - before) * np.uint64(_BACK)
        row, at = np.nonzero(np.column_stack([np.ones(len(m), dtype=bool), m[:, 1:] != m[:, :-1]]))  # the first of equal neighbours speaks for all
        yield k - 1, row, at, np.zeros(len(row), dtype=np.uint32), h[row, at]
    new = _values(alphabet)
    for i in range(k):
        row, c = np.nonzero(m[:, i][:, None] < alphabet)
        yield k, row, np.full(len(row), i), alphabet[c], total[row] + (new[c] - v[row, i]) * power[i]


def candidates(vocab: DataFrame, shards: Shards, at_once: int = BLOCKS) -> DataFrame:
    """``word``, ``n`` and ``other``: every edit of a word that the filters know; each pair of near words once, from one side, and few others."""
    spark = vocab.sparkSession
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # at most the 90 that runs are made of
    alphabet = np.array(sorted(ord(x.c) for x in letters if x.c), dtype=np.uint32)
    blocks = materialize(filter_blocks(vocab, shards))
    parts = []
    for low in range(0, shards.blocks, at_once):
        size = min(at_once, shards.blocks - low)
        got = blocks.filter(F.col("block").between(low, low + size - 1)).toArrow()
        bits = np.zeros((size, 4), dtype=np.uint64)
        bits[got.column(0).to_numpy() - low] = np.column_stack([got.column(i).to_numpy().view(np.uint64) for i in range(1, 5)])
        sent = spark.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch], low=low, size=size, sent=sent) -> Iterator[pa.RecordBatch]:
            bits = sent.value.ravel()

            def known(k: int, h: np.ndarray) -> np.ndarray:
                """Which of the hashes of words of this length may be in the vocabulary's part that is here."""
                block, which = shards.place(k, h)
                left = np.flatnonzero((block >= low) & (block < low + size))
                for i in range(BITS):
                    b = (which[left] >> np.uint64(8 * i)) & np.uint64(255)
                    lane = bits[(block[left] - low) * 4 + (b >> np.uint64(6)).astype(np.int64)]
                    left = left[(lane >> (b & np.uint64(63))) & np.uint64(1) == 1]
                return left

            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1)
                for k, rows, m in _by_length(batch.column(0)):
                    step = max(1, TOGETHER // (k + len(alphabet)))
                    for i in range(0, len(rows), step):
                        of, out = [], []
                        for length, row, at, new, h in _edits(k, m[i : i + step], alphabet, shards):
                            hit = known(length, h)
                            for r, a, c in zip(rows[i + row[hit]].tolist(), at[hit].tolist(), new[hit].tolist(), strict=True):
                                of.append(r)
                                out.append(words[r][:a] + (chr(c) if c else "") + words[r][a + 1 :])
                        if of:
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), n.take(pa.array(of)), pa.array(out, pa.string())], names=["word", "n", "other"])

        parts.append(vocab.select("word", "n").mapInArrow(run, "word string, n long, other string"))
    out = parts[0] if parts else vocab.select("word", "n", F.col("word").alias("other")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_words(vocab: DataFrame, at_once: int = BLOCKS) -> DataFrame:
    """Pairs of words of ``vocab`` (``word``, ``n``; a written table) that differ by one character, each from both sides: ``word``, ``other``, ``other_n``."""
    lengths = {r.k: r.m for r in vocab.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("m")).orderBy("k").collect()}  # a row for each length
    found = candidates(vocab, Shards(lengths), at_once)
    pairs = found.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    side = lambda w, o, n: F.struct(F.col(w).alias("word"), F.col(o).alias("other"), F.col(n).alias("other_n"))
    return pairs.select(F.inline(F.array(side("word", "other", "other_n"), side("other", "word", "n"))))


def group_variants(vocab: DataFrame, ratio: int = 5, at_once: int = BLOCKS) -> DataFrame:
    """Each word's usual form: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times the word's,
    else null, and so is ``form_n``; ``root`` is where the chain of forms ends, the word itself without one. Counts grow by the
    ratio from form to form, so chains are short whatever the corpus: following them doubles its steps in a few joins.
    ``vocab`` has different words and is a written table; an empty one gives no rows.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(vocab, at_once).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = vocab.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.n") >= ratio * F.col("n"), -F.col("best.n")))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("best.word")).alias("form"))
    out = materialize(out)
    top = out.agg(F.max("n")).first()[0] or 1
    forms = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    paths: list[str] = []
    for _ in range(math.ceil(math.log2(max(2.0, 1 + math.log(top, ratio))))):  # 2 ** rounds steps reach the end of any chain
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = forms.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        paths.append(stored(step))
        forms = vocab.sparkSession.read.schema(step.schema).parquet(paths[-1])
    for path in paths[:-1]:
        delete(vocab.sparkSession, path)
    if paths and forms.count() <= SMALL // 10:
        forms = F.broadcast(forms)
    return out.join(forms, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The words of all texts with their usual forms."""
    return group_variants(materialize(word_counts(docs)))


ORACLE = """
with recursive
tab as (select list(c order by i) t from (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) c
    from (select unnest(range(256)) i))),
low as (select coalesce(cast(doc_id as varchar), '') id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
runs as (select id, run, count(*) m from (select id, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) run from low) where length(run) >= 6 group by 1, 2),
coded as (select *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)) b from runs),
summed as (select run, m, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) h from coded, tab),
words as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, m from summed),
vocab as (select word, sum(m)::bigint n from words where length(word) >= 6 group by 1 having sum(m) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) i from vocab),
shorter as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) other from places),
deleted as (select s.word, s.n, v.word other, v.n other_n from shorter s join vocab v on s.other = v.word),
holes as (select word, n, left(word, i - 1) || '_' || substr(word, i + 1) h from places),
pairs as (
    select word, other, other_n from deleted union all select other, word, n from deleted
    union all select a.word, b.word, b.n from holes a join holes b on a.h = b.h and a.word <> b.word),
near as (select word, count(*) n_near, min({'n': -other_n, 'w': other}) best from pairs group by 1),
formed as (
    select v.word, v.n, coalesce(n_near, 0) n_near, case when -best.n >= 5 * v.n then best.w end form, case when -best.n >= 5 * v.n then -best.n end form_n
    from vocab v left join near using (word)),
chain as (
    select word, word last, 0 d from formed
    union all select c.word, f.form, d + 1 from chain c join formed f on c.last = f.word where f.form is not null),
roots as (select word, max_by(last, d) root from chain group by 1)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""
