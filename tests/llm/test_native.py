"""Line dedup, decontamination and chat formatting: SQL on the tables, and cases that the tables lack."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF, duck_rows, rows_of
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, line_dedup
from quire.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names, want = duck_rows(duck, ORACLE[name])
    assert sorted(df.columns) == names and rows_of(df) == want and want


def test_line_dedup_cases(spark):
    long = "A line that is Long enough to count"
    rows = [(1, f"{long}\nx"), (2, f"  {long.upper()}\t\nx"), (3, f"{long}\n{long}\n"), (4, None), (5, ""), (5, ""), (None, f"y\n{long}"), (6, "é" * 19), (7, "é" * 19), (8, "é" * 19)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOCS + ", n_lines int, h1 int")
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert (1, "x", 2, 1) in got and (2, "x", 2, 1) in got and (3, f"{long}\n{long}\n", 3, 0) in got
    assert (4, "", 1, 0) in got and (5, "", 1, 0) in got and (None, "y", 2, 1) in got and (8, "é" * 19, 1, 0) in got
    assert line_dedup.dedup_lines(df).count() == len(rows) and line_dedup.dedup_lines(df).columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_all_lines_gone(spark):
    t = "exactly the same line here"
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t) for i in range(4)], DOCS)).collect()}
    assert got == {0: ("", 1), 1: ("", 1), 2: ("", 1), 3: (t, 0)}


def test_line_dedup_rows_of_one_id(spark):
    """Rows that share an id, or have none, but differ in text: each loses its own lines only."""
    line = "a line that many documents hold"
    rows = [(1, line), (2, line), (9, line), (None, f"{line}\nown A"), (None, f"own B\n{line}"), (5, f"{line}\nfive"), (5, f"other\nmore\n{line}")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "", 1, 1), (2, "", 1, 1), (9, line, 1, 0), (None, "own A", 2, 1), (None, "own B", 2, 1), (5, "five", 2, 1), (5, "other\nmore", 3, 1)}


def brute_windows(text, items, n=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        k = min(n, len(iw))
        for s in range(len(iw) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == iw[s : s + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [50_000, 3])
def test_decontaminate_against_brute_force(spark, most):
    rng = random.Random(3)
    vocab = ["the", "of", "É", "a1", "b", "cat"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(k)) for i, k in enumerate([25, 12, 10, 9, 7, 3, 11, 0])] + [(90, None), (91, "..."), (92, text(14))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(100, items[0][1].upper() + "!"), (101, None), (102, ""), (103, items[4][1]), (104, "x, " + items[10][1] + " y")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_windows(d, b, max_set=most).collect()}
    assert got == {i: brute_windows(t, items) for i, t in docs}


def test_decontaminate_removes(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, f"Keep this, {item.upper()}. And that."), (2, "clean"), (2, "clean"), (3, None), (None, item)], DOCS)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontaminate.decontaminate(d, b).filter("doc_id IS NOT NULL").collect() if r.text) == [(2, "clean"), (2, "clean")]
    assert decontaminate.decontaminate(d, b).count() == 3
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, remove="spans").collect()}
    assert spans == {1: "Keep this. And that.", 2: "clean", 3: None, None: ""}
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 5 and decontaminate.find_windows(d.limit(0), b).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b\\\\<|end|>", "<|turn|>user<|text|>", "", None, "\\", "<s><<SYS>>é\n", "<<|"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 0, "assistant", "y")]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert not re.search(r"</?s>|\[/?INST\]", got[1].formatted)
    loss = [got[1].formatted[s.start : s.end] for s in got[1].loss]
    assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in loss] == [t or "" for i, t in enumerate(texts) if i % 2]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x")] and len(got[None].loss) == 1


def test_chat_fold(spark):
    ev = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "Hel"), (1, 3, "delta", 1, "assistant", "lo"), (1, 3, "delta", 1, "assistant", "lo"),
        (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "Good"), (1, 7, "delta", 1, "assistant", " day"), (1, 8, "message", 2, "user", "thanks"),
        (2, 1, "message", 0, "user", "a"), (2, 2, "message", 1, "assistant", "b"), (2, 3, "edit", 0, "user", "c"),
    ]
    rows = chat.fold_events(spark.createDataFrame(ev, "conv_id long, seq long, kind string, turn long, role string, text string")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, "user", "hi"), (1, 1, "assistant", "Good day"), (1, 2, "user", "thanks"), (2, 0, "user", "c")]


def test_chat_digest_has_the_probe(spark):
    r = {x.conv_id: x for x in chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert list(r) == [-7] and r[-7].n_turns == 2 and r[-7].loss_chars == len(probe) and r[-7].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()


INTERNAL = ["_id", "_key", "_text", "_drops", "_lines", "_t", "_a", "_b", "_h1", "_h2", "_spans", "_k1", "_k2", "_drop", "drop", "_stats", "_keep", "row", "id", "k1", "stats", "log_chars", "node", "rep", "grp", "w", "g", "_hits", "component_id", "n_shingles", "cluster"]


def test_names_of_a_users_columns_do_not_clash(spark):
    """Columns named as an operator's own come back as they were, and nothing else changes."""
    import corpus_pipeline
    from quire.llm import jaccard_join, quality

    rows = [(i, f"line number {i} of many, long enough\nthe quick brown fox jumps over the lazy dog again {i % 3}", f"s{i}") for i in range(12)] + [(3, None, None), (None, "", "s")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = plain.select("*", *[F.lit(77).alias(c) for c in INTERNAL])
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again 1")], "item_id long, text string")
    model = quality.fit_rules(np.random.default_rng(0).random((200, 2)), (np.arange(200) % 2).astype(float), ["log_chars", "upper"])
    cases = {
        "lines": line_dedup.dedup_lines, "whole": lambda d: decontaminate.decontaminate(d, items), "spans": lambda d: decontaminate.decontaminate(d, items, remove="spans"),
        "set": lambda d: decontaminate.decontaminate(d, items, max_set=0), "one": lambda d: jaccard_join.keep_one(d, n=2, num=1, den=2), "score": lambda d: quality.classify(d, model),
        "good": lambda d: quality.keep_good(d, model, threshold=0.5),
    } | {f"stage {n}": lambda d, f=f: f(spark, d, SF) for n, f in corpus_pipeline.STAGES[:-1]}
    for name, f in cases.items():
        got, want = f(docs), f(plain)
        assert [c for c in got.columns if c not in INTERNAL] == want.columns, name
        assert rows_of(got.select(*want.columns)) == rows_of(want), name
        assert all(set(r) == {77} for r in got.select(*INTERNAL).collect()), name
    packed = corpus_pipeline.STAGES[-1][1]
    assert rows_of(packed(spark, docs, SF)) == rows_of(packed(spark, plain, SF))
    for name, f in cases.items():
        assert f(docs.limit(0)).count() == 0, name


def test_names_in_another_case_and_with_marks(spark):
    """Names that differ from an operator's own in case only, or hold dots and backticks."""
    import corpus_pipeline
    from quire.llm import jaccard_join, quality

    rows = [(i, f"line number {i} of many, long enough\nthe quick brown fox jumps over the lazy dog again {i % 3}", f"s{i}") for i in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = ["N_LINES", "N_Dropped", "Score", "PREDICTED", "Row", "Stats", "a.b", "c`d", "`", "text.x"]
    docs = plain.select("*", *[F.lit(77).alias(c) for c in odd])
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again 1")], "item_id long, text string")
    model = quality.fit_rules(np.random.default_rng(0).random((200, 2)), (np.arange(200) % 2).astype(float), ["log_chars", "upper"])
    same = {
        "texts": line_dedup.dedup_texts, "whole": lambda d: decontaminate.decontaminate(d, items), "spans": lambda d: decontaminate.decontaminate(d, items, remove="spans"),
        "one": lambda d: jaccard_join.keep_one(d, n=2, num=1, den=2), "good": lambda d: quality.keep_good(d, model, threshold=0.5),
    } | {f"stage {n}": lambda d, f=f: f(spark, d, SF) for n, f in corpus_pipeline.STAGES[:-1]}
    for name, f in same.items():
        got = f(docs)
        assert got.columns == docs.columns, name
        assert sorted(r[:3] for r in got.collect()) == sorted(tuple(r) for r in f(plain).collect()), name
        assert all(set(r[3:]) == {77} for r in got.collect()), name
    lines, scored = line_dedup.dedup_lines(docs), quality.classify(docs, model)
    assert lines.columns == ["doc_id", "text", "source", *odd[2:], "n_lines", "n_dropped"]
    assert scored.columns == ["doc_id", "text", "source", *odd[:2], *odd[4:], "score", "predicted"]
    assert scored.filter("score > 0").count() == 12
    assert lines.filter("n_lines = 2").count() == 12
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == len(corpus_pipeline.STAGES[-1][1](spark, plain, SF).collect())


def played(events):
    """A log applied event by event."""
    turns = {}
    for _, kind, turn, role, text in sorted(events):
        if kind in ("edit", "regenerate"):
            turns = {t: v for t, v in turns.items() if t <= turn}
        if kind == "delta" and turn in turns:
            turns[turn] = (turns[turn][0], turns[turn][1] + text)
        else:
            turns[turn] = (role, "" if kind == "regenerate" else text)
    return turns


def test_logs_fold_as_they_play(spark):
    """Random logs against a plain loop: restarts, edits, answers streamed after an edit, late deltas."""
    rng, rows, want = random.Random(5), [], {}
    logs = [[(0, "message", 0, "user", "q"), (1, "delta", 1, "bot", "old"), (2, "delta", 1, "bot", "er"), (3, "edit", 0, "user", "Q"), (4, "delta", 1, "bot", "new"), (5, "delta", 1, "bot", "er")]]
    for _ in range(150):
        logs.append([(s, rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 3), rng.choice(["user", "bot"]), rng.choice("abc")) for s in range(rng.randint(1, 14))])
    for c, log in enumerate(logs):
        want |= {(c, t): v for t, v in played(log).items()}
        shuffled = log + rng.sample(log, len(log) // 2)  # delivered twice, out of order
        rng.shuffle(shuffled)
        rows += [(c, *e) for e in shuffled]
    got = chat.fold_events(spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string"))
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in got.collect()} == want and want[0, 1] == ("bot", "newer")
