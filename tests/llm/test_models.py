"""Quality, language model and pipeline."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import lm, quality
from quire.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_scores_against_plain_rules(spark):
    """Every compiled score, from statistics in plain Python and the rules one by one."""
    import string

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    assert 3 < len(model.rules) < 200
    got = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    for r in docs.collect():
        t = r.text or ""
        w, lines, n, most = t.split(" "), t.split("\n"), len(t), max(len(t), 1)
        share = lambda chars: sum(c in chars for c in t) / most  # noqa: E731, B023
        x = {
            "log_chars": math.log1p(n), "word_chars": n / len(w), "upper": share(string.ascii_uppercase), "digits": share(string.digits), "stops": share(".,;:?"), "shouts": share("!"),
            "symbols": share("#$%&*|<>{}[]_=+~^\\/@"), "distinct_words": len(set(w)) / len(w), "distinct_words_by_length": math.log1p(len(set(w))) / math.log1p(len(w)),
            "line_chars": math.log1p(n / len(lines)), "distinct_lines": len(set(lines)) / len(lines),
        }
        total = model.bias + sum(weight for rule, weight in model.rules if all((x[k] > at) == above for k, above, at in rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_quality_ignores_all_but_text(spark):
    """Labels of the held-out fold, languages and sources change no score."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    want = {(r.doc_id, r.score) for r in quality.digest(docs, labels).collect()}
    assert {(r.doc_id, r.score) for r in quality.digest(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), other).collect()} == want


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (3, "x " * 5000, 5)], DOCS + ", score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.classify(docs, model)
    assert [c for c in out.columns] == ["doc_id", "text", "score", "predicted"] and {r.score for r in out.collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0
    one = quality.fit_rules(np.zeros((10, 2)), np.ones(10), ["a", "b"])
    assert one.rules == () and one.bias > 0


def brute_base(docs):
    c, n = {}, 0
    for i, w in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for x in w:
                c[x] = c.get(x, 0) + 1
                n += 1
    return c, n


def test_lm_counts_and_scores(spark):
    rows = [(i, (t or "").encode().lower().split() + [b"</end>"]) for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op2_hpylm"](spark, SF).collect()}
    c, n = brute_base(rows)
    base = score = 0.0
    for i, w in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - sum(math.log10((c.get(x, 0) + 1) / (n + len(c) + 1)) for x in w)) < 1e-6
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base


def model_of(spark, m):
    """Brute force from the model's tables: p(word | context) for all pairs, words by number (None is END)."""
    k = len(m.seats)
    words = {r.w: r for r in spark.read.parquet(m.words).collect()}
    q = {w: [m.once[s] if r.c == 1 else r[f"q{s}"] for s in range(k)] for w, r in words.items()}
    t, c = [{} for _ in range(k)], {}
    for b in spark.read.parquet(m.pairs).filter("bucket >= 0").collect():
        u, w, at, to, n = lm._pairs(bytes(b.pairs))
        key = list(zip(u[at].view(np.int64).tolist(), w[to].view(np.int64).tolist(), strict=True))
        c |= {x: y for x, y in zip(key, n.tolist(), strict=True) if y}
        for s, path in enumerate(m.seats):
            a = lm.load(bytes(spark.read.parquet(path).filter(f"data IS NOT NULL AND bucket = {b.bucket}").first().data))
            many = iter(a[7].tolist())
            t[s] |= {x: next(many) if y > 1 else 1 for x, y in zip(key, n.tolist(), strict=True) if y}
    cu, tu = {}, [{} for _ in range(k)]
    for (u, w), n in c.items():
        cu[u] = cu.get(u, 0) + n
        for s in range(k):
            assert 1 <= t[s][u, w] <= n
            tu[s][u] = tu[s].get(u, 0) + t[s][u, w]

    def p(u, w):
        total = 0.0
        for s in range(k):
            low = q[w][s] if w in q else m.unknown[s]
            down = (m.theta + m.d * tu[s][u]) / (m.theta + cu[u]) if u in cu else 1.0
            own = (c[u, w] - m.d * t[s][u, w]) / (m.theta + cu[u]) if (u, w) in c else 0.0
            total += own + down * low
        return total / k

    return p, words, c


def number(m, w):
    return 0 if w is None else int(m.head.keys(lm.word_hashes(w))[0].astype(np.int64))


@pytest.mark.parametrize("bucket_tokens", [900_000, 20])
def test_lm_seats_every_pair_and_adds_up(spark, bucket_tokens):
    """Every pair has seats, probabilities after any context add up to 1, and scores are their logarithms; with few short codes and contexts dealt by pair too."""
    texts = ["a b a b c", "a b", "b a a", None, "", "d", "x y z", "rare one", "once seen"] * 4 + ["single words here", "a b never known"]
    docs = spark.createDataFrame([(i, t, i != len(texts) - 1, 0) for i, t in enumerate(texts)], DOCS + ", learn boolean, w int")
    m = lm.learn(docs, which=docs.learn, bucket_tokens=bucket_tokens, short_codes=4 if bucket_tokens < 100 else lm.HEAD)
    p, words, c = model_of(spark, m)
    want = {}
    for t in texts[:-1]:
        w = (t or "").split() + [None]
        for u, x in zip([None, *w[:-1]], w, strict=True):
            key = number(m, u), number(m, x)
            want[key] = want.get(key, 0) + 1
    assert c == want and len(words) == m.v
    for u in words:
        assert sum(p(u, w) for w in words) + p(u, "unknown") == pytest.approx(1, abs=1e-6)
    got = {r.doc_id: r for r in lm.score(spark, m).collect()}
    for i, t in enumerate(texts):
        w = [number(m, x) for x in [None, *(t or "").split(), None]]
        assert got[i].score == pytest.approx(sum(math.log10(p(*x)) for x in zip(w[:-1], w[1:], strict=True)))
        assert (got[i].n_tokens, got[i].n_known) == (len(w) - 1, sum(x in words for x in w[1:]))
    lm.forget(spark, m)


def test_lm_digest_without_rows_or_learnt_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert lm.digest(none).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    got = lm.digest(spark.createDataFrame([(i, "x y") for i in held], DOCS)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(i, True, 3, 0, 0) for i in held]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quire_")]


def test_lm_failure_leaves_no_table(spark, monkeypatch):
    def fail(*_):
        raise ValueError("no seats")

    monkeypatch.setattr(lm, "_start", fail)
    with pytest.raises(Exception, match="no seats"):
        lm.learn(spark.createDataFrame([(1, "x y")], DOCS))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quire_")]


def test_lm_empty(spark):
    none = spark.createDataFrame([], DOCS)
    m = lm.learn(none)
    assert lm.score(spark, m).count() == 0
    m = lm.learn(spark.createDataFrame([(1, "x y"), (2, None), (2, "z"), (None, "w")], DOCS), which=F.lit(None).cast("boolean"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm.score(spark, m).collect() if math.isfinite(r.score))
    assert got == [(0, 2, 0), (1, 3, 0), (2, 1, 0), (2, 2, 0)]


def log_stirling(d, most):
    """Row by row, in logarithms."""
    row = np.full(most + 2, -np.inf)
    row[1] = 0
    for c in range(1, most):
        t = np.arange(most + 2)
        row = np.logaddexp(np.concatenate([[-np.inf], row[:-1]]), row + np.log(np.maximum(c - d * t, 1e-300)))
        row[c + 2 :] = -np.inf
    return row[1 : most + 1]


@pytest.mark.parametrize("customers", [2, 3, 17, 256, 257, 400, 900])
@pytest.mark.parametrize("x", [1e-4, 0.05, 0.7, 6.0, 150.0])
def test_tables_are_drawn_from_their_conditional(customers, x):
    d, n = 0.7, 20_000
    logs = log_stirling(d, customers) + np.arange(1, customers + 1) * math.log(x)
    p = np.exp(logs - logs.max())
    p /= p.sum()
    mean = (p * np.arange(1, customers + 1)).sum()
    spread = math.sqrt((p * (np.arange(1, customers + 1) - mean) ** 2).sum())
    got = lm.draw_tables(np.full(n, customers), np.full(n, x), d, lm.stirling(d), np.random.default_rng(1))
    # exact up to 256 customers; the approximation beyond is off by a tenth of a table or 2.5 % at most
    off = 4 * spread / math.sqrt(n) + 1e-9 if customers <= lm.EXACT else 0.1 + 0.025 * mean
    assert abs(got.mean() - mean) <= off and abs(got.std() - spread) <= max(off, 0.05 * spread, 0.01) and got.min() >= 1 and got.max() <= customers


def test_gibbs_finds_the_posterior():
    """Alternating y and tables gives the joint distribution of a restaurant's tables, enumerated."""
    d, theta, c, q, chains = 0.6, 1.0, np.array([5, 3, 1, 8]), np.array([0.2, 0.05, 0.3, 0.01]), 4000
    logs = lm.stirling(d)
    expect, norm = 0.0, 0.0
    for t in np.ndindex(*c.tolist()):
        t = np.array(t) + 1
        weight = math.exp(sum(logs[n, k] + k * math.log(x) for n, k, x in zip(c, t, q, strict=True)) + sum(math.log(theta + d * i) for i in range(t.sum())))
        expect, norm = expect + weight * t, norm + weight
    rng = np.random.default_rng(3)
    t = np.ones((chains, len(c)), dtype=np.int64)
    for _ in range(25):
        y = rng.standard_gamma(theta / d + t.sum(axis=1))
        t = lm.draw_tables(np.tile(c, chains), (d * y[:, None] * q).ravel(), d, logs, rng).reshape(chains, -1)
    assert np.abs(t.mean(axis=0) - expect / norm).max() < 0.05


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    from quire.llm.common import materialize

    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    fill = {r.bin_id: r["s"] for r in docs.groupBy("bin_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "s").collect()}
    assert max(fill.values()) <= 4096


def test_pipeline_against_brute_force(spark):
    """Each stage's rows on the smallest tables, from its input, in plain Python."""
    import re

    from test_text_ops import brute_components

    from quire.llm.common import materialize

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.classify(docs, model).collect() if r.predicted == 1}
    docs = materialize(stages["quality classifier"](spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == good

    holders, texts = {}, {r.doc_id: r.text or "" for r in docs.collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(ids) for k, ids in holders.items() if len(k) >= 20 and len(ids) >= 3}
    texts = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}
    docs = materialize(stages["line dedup"](spark, docs, SF))
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    roots = brute_components(list(texts.items()), 5, 4, 5)
    docs = materialize(stages["n-gram jaccard join"](spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == set(roots.values())

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower().decode())
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text or "")
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if k else 0)}
    sizes = {len(x) for x in windows}
    clean = {i for i in set(roots.values()) if not any(tuple(w[j : j + k]) in windows for w in [words(texts[i])] for k in sizes for j in range(len(w) - k + 1))}
    docs = materialize(stages["benchmark decontamination"](spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == clean

    from quire.llm import encoder

    enc = encoder.encoder(encoder.default_tokenizer())
    got, lengths = {}, {i: len(enc.tokenizer.encode(texts[i], add_special_tokens=False).ids) for i in clean}
    for r in stages["best-fit packing"](spark, docs, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == lengths
