"""Spelling variants against their SQL and against all pairs of words."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import pytest
from conftest import SF, duck_rows, rows_of

from quire.llm import variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n: dict[str, int]) -> list[tuple]:
    others: dict[str, list[str]] = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            others[a].append(b)
            others[b].append(a)
    form = {}
    for w, o in others.items():
        best = min(o, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("at_once", [variants.BLOCKS, 3])
def test_equals_all_pairs(spark, at_once):
    r = random.Random(3)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(6, 8))) for _ in range(700)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿ"}
    n = {w: r.choice([5, 6, 30, 31, 200, 1000, 5000, 25000]) for w in words}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted(((x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.group_variants(vocab, at_once=at_once).collect()))
    assert got == plain(n)
    assert any(x[2] != (x[1] or x[0]) for x in got)  # chains of more than one step


def test_equals_sql(spark, duck):
    names, want = duck_rows(duck, variants.ORACLE)
    got = variants.digest(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(got.columns) == names
    assert rows_of(got) == want
    assert want


def test_counts(spark):
    texts = ["Straße, STRASSEN straßen!", None, "", "abcdefg " * 400, "AÉÉÉÉÉ x1abcdefgx2", "é" * 9000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "abcdefg abcdefgh"), (3, "abcdefg " * 400)]
    want: Counter = Counter()
    import re

    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, `ID` string, `N` int")
    got = {r.word: r.n for r in variants.word_counts(frame, min_n=1, drop_one_in=3).collect()}
    assert got == {w: k for w, k in want.items() if len(w) >= 6}
    assert variants.digest(frame.limit(0)).collect() == []
