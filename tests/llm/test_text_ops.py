"""Jaccard join, fingerprints, token counts, token files and packing against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import encoder, fingerprint, jaccard_join, packing, signature_tree, token_counts, token_files
from quire.llm.common import scratch
from quire.llm.components import components
from quire.llm.words import shingles

DOCS = "doc_id long, text string"


def brute_components(docs, n, num, den):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a, (i, s) in enumerate(flat):
        for j, r in flat[:a]:
            if den * len(s & r) >= num * len(s | r):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_copies(seed, n_docs, words=60, changes=4):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(words)] for _ in range(5)]
    out = []
    for i in range(n_docs):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(len(t))] = f"n{rng.randint(0, 9)}"
        out.append((i * 3, " ".join(t[: rng.choice([len(t), len(t) - 2, 5, 1])])))
    return out


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_against_brute_force(spark, n, num, den):
    docs = near_copies(1, 150) + [(1000, None), (1001, ""), (1002, "  "), (1003, "One two"), (1004, "one  TWO\n"), (3, "x"), (7, "x")]
    want = brute_components(docs, n, num, den)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS + ", node int, rep int, token int")
    got = jaccard_join.jaccard_components(df, n=n, num=num, den=den).collect()
    assert len(got) == len(docs) and {r.doc_id: r.component_id for r in got} == want


def test_jaccard_in_chunks(spark, monkeypatch):
    """Groups beyond the bound meet chunk by chunk."""
    docs = near_copies(2, 120)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 7)
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(docs, 3, 9, 10)


@pytest.mark.parametrize("members,block,step", [(5, 4, 2), (3, 1000, 3), (1000, 3, 3)])
def test_jaccard_in_chunks_of_chains(spark, monkeypatch, members, block, step):
    """Sliding windows over one long text link in chains, or hardly; blocks and groups are cut into very small chunks."""
    rng = random.Random(members)
    long = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    docs = [(rng.randint(0, 10**9), " ".join(long[i : i + 40 + i % 3])) for i in range(0, 300, step)]
    docs += near_copies(4, 60) + [(docs[0][0], "w1 w2 w3 w4"), (docs[0][0], docs[50][1])]
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, DOCS), n=2).collect()
    assert len(got) == len(docs) and {r.doc_id: r.component_id for r in got} == brute_components(docs, 2, 9, 10)


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = jaccard_join.jaccard_components(spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in rows) == [(0, 0, 2), (1, 1, 2), (1, 1, 2)]
    kept = jaccard_join.keep_one(spark.createDataFrame([(5, "a b c d"), (2, "A b c d"), (9, "z")], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]


def test_signature_tree_finds_every_component():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, size=rng.integers(1, 1800)).astype(np.uint64)
        for _ in range(20):
            s = base.copy()
            k = rng.integers(0, max(1, len(s) // 8) + 1)
            s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 2**63, size=k).astype(np.uint64)
            sets.append(np.unique(s))
    ok = lambda i, j: signature_tree.common(sets[i], sets[j]) * 10 >= 9 * (len(sets[i]) + len(sets[j]) - signature_tree.common(sets[i], sets[j]))
    n = np.array([len(s) for s in sets])

    def roots(links):
        r = list(range(len(sets)))
        def find(i):
            while r[i] != i:
                i = r[i]
            return i
        for a, b in links:
            x, y = find(a), find(b)
            r[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(sets))]

    want = roots((i, j) for i in range(len(sets)) for j in range(i) if ok(i, j))
    sig = np.stack([signature_tree.bitmap(s, 4096) for s in sets])
    assert roots(signature_tree.link(n, sig, 9, 10, ok)) == want
    coarse = roots(signature_tree.link_any(n, [signature_tree.bitmap(s, signature_tree.width(len(s))).tobytes() for s in sets], 9, 10))
    assert all(coarse[i] == coarse[j] for i in range(len(sets)) for j in range(len(sets)) if want[i] == want[j])


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (2, 1)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=2000))
def test_chunks_cover_the_text(text):
    data = text.encode("utf-8", "surrogatepass")
    ends = fingerprint.chunk_ends(data)
    assert (ends[-1] if ends else 0) == len(data) and all(0 < b - a <= fingerprint.GREATEST for a, b in zip([0, *ends], ends, strict=False))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_chunks_against_a_byte_by_byte_loop(data, repeat):
    data = (data * repeat)[:9000]
    gear, ends, start, h = fingerprint._gear().tolist(), [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        n = i + 1 - start
        zero = fingerprint.HARD if n < fingerprint.USUAL else fingerprint.EASY
        if n >= fingerprint.LEAST and (h < 1 << (32 - zero) or n == fingerprint.GREATEST) and i + 1 < len(data) or i + 1 == len(data):
            ends.append(i + 1)
            start = i + 1
    assert fingerprint.chunk_ends(data) == ends


def test_chunks_survive_shifts():
    rng = random.Random(0)
    text = " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(800))
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint("inserted here " + text)
    assert fingerprint.containment(a, b) > 0.95 and fingerprint.containment(a, a) == 1
    assert fingerprint.containment({}, {}) == 1 and fingerprint.containment({}, a) == 0 and fingerprint.containment(a, {}) == 0


def test_fingerprints_of_neighbours(spark):
    docs = [(5, "fünf " * 30), (1, "one " * 50), (9, None), (3, ""), (None, "none " * 20), (7, "abc"), (7, "abd")]
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    order = [r for r in order if r[0] == 9] + [(7, "abc"), (7, "abd")] + [r for r in order if r[0] not in (9, 7)]
    got = {(r.doc_id, r.fingerprint): r for r in fingerprint.digest(spark.createDataFrame(docs, DOCS)).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        f = fingerprint.fingerprint(t)
        r = got[(i, fingerprint.as_text(f))]
        e = fingerprint.fingerprint(fingerprint.edited(t or "", nxt))
        assert (r.edited_fingerprint, r.near_edited, r.near_next) == (fingerprint.as_text(e), fingerprint.containment(f, e), fingerprint.containment(f, fingerprint.fingerprint(nxt)))
    assert fingerprint.digest(spark.createDataFrame([(1, "alone")], DOCS)).first().near_next == 1
    assert fingerprint.digest(spark.createDataFrame([], DOCS)).count() == 0


WORDS = ["The", "cat's", "élan,", "<|endoftext|>", "naïve!!", "x&amp;", "漢字", "", "\t", "a b", "ǅ", "é", "don't", "3rd", "***"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(WORDS) | st.text(max_size=8), max_size=30), st.sampled_from([" ", "\n", "  "]))
def test_words_encode_as_texts_do(words, gap):
    enc, text = encoder.encoder(encoder.default_tokenizer()), gap.join(words)
    assert enc.ids([text])[0] == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    enc = encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["The Cat's  naïve\n", None, "", "ABC abc Abc", "x <|endoftext|> y"]
    assert not enc.by_word and encoder.encoder(encoder.default_tokenizer()).by_word
    assert enc.ids(texts) == [np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [len(x) // 4 for x in enc.ids(texts)] == enc.lengths(pa.array(texts, pa.string())).tolist()


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, size=n).astype("<u4").tobytes()
    index, data = token_files.pack(ids, planes, 64)
    assert token_files.unpack(index, data, planes, 64, n) == ids and len(index) == -(-n // 64) * planes + 1


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, planes):
    docs = [(4, "four words are here"), (2, None), (3, ""), (1, "long " * 5000), (7, "x"), (7, "y")]
    path = scratch(spark)
    token_files.write_token_files(spark.createDataFrame([(i, t, 0) for i, t in docs], DOCS + ", ids int"), path, planes=planes, block=100, container=50)
    rows = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_token_files(spark, path).collect())
    enc, at = encoder.encoder(encoder.default_tokenizer()), 0
    for (i, t), r in zip(sorted(docs, key=lambda x: (x[0], x[1] or "")), rows, strict=True):
        ids = enc.ids([t])[0] + (1).to_bytes(4, "little")
        assert r == (at, i, len(ids) // 4, ids)
        at += len(ids) // 4
    empty = scratch(spark)
    token_files.write_token_files(spark.createDataFrame([], DOCS), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_on_the_table(spark):
    from quire.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    enc, at = encoder.encoder(encoder.default_tokenizer()), 0
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, SF).collect()}
    for i, t in docs:
        ids = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_histogram(spark):
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 5, 1023, 1024, 1025, 5000, 100_000]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    hist = token_counts.length_histogram(df)
    for r in hist.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n) and r.n_fit == sum(x <= n for x in lengths) and r.n_longer == sum(x > n for x in lengths)
        assert r.fit_tokens == sum(x for x in lengths if x <= n) and r.longer_tokens == sum(x for x in lengths if x > n) and r.truncated_total == sum(min(x, n) for x in lengths)
    got = {r.context_limit: (r.n_fit, r.truncated_total) for r in token_counts.at_limits(hist, [0, 3, 2048, 10**6]).collect()}
    assert got == {k: (sum(x <= k for x in lengths), sum(min(x, k) for x in lengths)) for k in got} and len(got) == 4
    assert token_counts.quantile(hist, 0.5).first().n_tokens == sorted(lengths)[149]
    none = token_counts.length_histogram(df.limit(0))
    assert none.count() == 0 and token_counts.at_limits(none, [7]).first().truncated_total == 0


def test_token_counts_on_the_table(spark):
    from quire.llm.queries import QUERIES

    enc = encoder.encoder(encoder.default_tokenizer())
    n = [len(enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op8_token_counts"](spark, SF).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {x: n.count(x) for x in n}


def naive_fit(sizes, sources, clusters, capacity, most):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and not (c is not None and c in b["c"]) and not (s is not None and b["s"].count(s) >= most)]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": [], "c": []})
            k = len(bins) - 1
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["s"].append(s)
        bins[k]["c"].append(c)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4])), max_size=60), st.integers(1, 3))
def test_best_fit_against_all_bins(pieces, most):
    args = [list(x) for x in zip(*pieces, strict=True)] if pieces else [[], [], []]
    assert packing.best_fit(*args, capacity=20, max_per_source=most) == naive_fit(*args, 20, most)


def test_pack_places_everything(spark):
    rows = [(i, (i * 37) % 300, f"s{i % 3}" if i % 10 else None, i % 4 if i % 2 else None) for i in range(500)] + [(600, None, None, None), (601, -5, "s1", 1), (602, 1000, "s1", 2), (602, 1000, "s1", 2)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    got = packing.pack(df, capacity=128, max_per_source=2, group=100).collect()
    assert sum(r.n_tokens for r in got) == sum(max(n or 0, 0) for _, n, _, _ in rows)
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    info = {i: (s, c) for i, _, s, c in rows}
    bins: dict = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: (r.bin_start, r.n_tokens))
        assert all(x.bin_start + x.n_tokens <= y.bin_start for x, y in zip(b, b[1:], strict=False)) and b[-1].bin_start + b[-1].n_tokens <= 128
        sources, clusters = [info[r.doc_id][0] for r in b if info[r.doc_id][0]], [info[r.doc_id][1] for r in b if info[r.doc_id][1] is not None]
        assert all(sources.count(s) <= 2 for s in sources) and len(set(clusters)) == len(clusters)
    assert packing.pack(df.limit(0)).count() == 0


def test_pack_groups_rows_of_one_id(spark):
    """Rows without an id, or of one id, are dealt to groups as others are."""
    rows = [(None if i % 2 else 7, 10 + i % 50, f"s{i % 9}", i) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long"), capacity=128, group=100).collect()
    groups: dict = {}
    for r in got:
        groups[r.bin_id // packing.BINS] = groups.get(r.bin_id // packing.BINS, 0) + 1
    assert len(got) == 2000 and sum(r.n_tokens for r in got) == sum(r[1] for r in rows)
    assert len(groups) == 20 and max(groups.values()) < 200


def test_pack_deals_equal_rows_to_groups(spark, monkeypatch):
    """Rows equal in every column are many documents: none is lost, and no group holds them all."""
    monkeypatch.setattr(packing, "COPIES", 7)
    rows = [(None, 0, None, None)] * 1500 + [(3, 50, "s", 1)] * 400 + [(4, 300, None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    got = packing.pack(df, capacity=128, group=100).collect()
    groups: dict = {}
    for r in got:
        groups[r.bin_id // packing.BINS] = groups.get(r.bin_id // packing.BINS, 0) + 1
    assert [sum(r.doc_id == i for r in got) for i in (None, 3, 4)] == [1500, 400, 150]
    assert sum(r.n_tokens for r in got) == 400 * 50 + 50 * 300
    assert len(groups) == 20 and max(groups.values()) < 200
    assert len({r.bin_id for r in got if r.doc_id == 3}) == 400  # one cluster: a bin for each
    kept = packing.copies(df.limit(0))
    assert kept.count() == 0 and kept.columns == [*df.columns, "copy"]


def test_shingles_of_few_words():
    assert len(shingles(None, 3)) == 0 and len(shingles(" \n", 3)) == 0 and len(shingles("a b", 3)) == 1
    assert (shingles("A b", 3) == shingles("a\tB", 3)).all() and len(shingles("a b a b a b", 2)) == 2
