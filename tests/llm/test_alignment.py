"""Token alignment against a plain loop over whole texts' tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from quire.llm import align

ODD = list("abcdeABC  \n\n\t.,'-é ßüñ中文🎉ꙮ ​▁<|>0123é́s\r\x00\x1c")
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    r = random.Random(5)
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "<|endoftext|> x", "<s> </s>", "x " * 3000, "a ▁ b", "the cat the cat", "the cat"]
    return out + ["".join(r.choice(ODD) for _ in range(r.randint(1, 40))) for _ in range(1200)]


def whole(texts: list[str | None]) -> list[tuple]:
    """Each text encoded as a whole; groups by walking both token lists."""
    own = align.Aligner(*align.default_paths())
    docs = []
    for t in texts:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        x, y = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(([], [], []))
            continue
        groups, ga, gb, i, j, ea, eb = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if ea <= eb and i < len(a):
                ea, i = ea + len(x[i]), i + 1
                ga.append(a[i - 1])
            else:
                eb, j = eb + len(y[j]), j + 1
                gb.append(b[j - 1])
            if ea == eb and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((a, b, groups))
    links = [[(p, q) for ga, gb in g for p in ga for q in gb] for _, _, g in docs]
    n = Counter(x for each in links for x in set(each))
    most: dict[int, int] = {}
    for (p, _), k in n.items():
        most[p] = max(most.get(p, 0), k)
    out = []
    for k, ((a, b, g), own_links) in enumerate(zip(docs, links, strict=True)):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((k, len(a), len(b), len(g), len(own_links), sum(n[x] == most[x[0]] for x in own_links), sum(n[x] for x in own_links), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


@pytest.mark.parametrize("at_once", [align.PAIRS, 900])
def test_equals_whole_texts(spark, texts, at_once, monkeypatch):
    monkeypatch.setattr(align.with_scores, "__defaults__", (at_once, None, None))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r[c] for c in COLS) for r in align.digest(docs).collect())
    assert got == whole(texts)
    assert sum(x[1] == 0 for x in got) > 3
    assert any(x[5] < x[4] for x in got)


def test_table_begins_anew(texts, monkeypatch):
    import pyarrow as pa

    some = pa.array([t for t in texts[5:400] if t])
    own = align.Aligner(*align.default_paths())
    want = own.align(pa.array(range(len(some))), some).to_pylist()
    monkeypatch.setattr(align, "KEEP", 3)
    monkeypatch.setattr(align, "TOGETHER", 7)
    own = align.Aligner(*align.default_paths())
    got = [own.align(pa.array([i]), some.slice(i, 1)).to_pylist()[0] for i in range(len(some))]
    assert got == want


def test_nulls_repeats_clashes_and_nothing(spark):
    docs = spark.createDataFrame([(None, "the cat", 1), (7, "the cat", 2), (7, "the cat", 3), (8, None, 4)], "doc_id long, text string, N_A int").withColumnRenamed("N_A", "n_A")
    got = sorted(tuple(-1 if r[c] is None else r[c] for c in COLS[:7]) for r in align.digest(docs).collect())
    assert [x[0] for x in got] == [-1, 7, 7, 8]
    assert got[0][1:] == got[1][1:] == got[2][1:]
    assert got[0][6] == 3 * got[0][4]
    assert got[3][1:] == (0,) * 6
    assert align.digest(docs.limit(0)).collect() == []
