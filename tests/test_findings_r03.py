"""What round 3 found to grow too fast, against plain loops and by what the work is made of."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import helpers as h
from quire.functions import text


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def justified(left: str, center: str, right: str, width: int = 72) -> str:
    parts = [left.rstrip(" "), center.strip(" "), right.strip(" ")]
    over = sum(map(len, parts)) - width
    if over > 0:
        k = max(range(3), key=lambda i: len(parts[i]))
        parts[k] = parts[k][: max(len(parts[k]) - over, 0)]
    a, b, c = parts
    gap = width - len(b)
    before = (gap if len(b) % 2 == 0 else gap + 1) // 2
    mid, end, line = (" " * max(before, 0) + b).ljust(width)[:width], c.rjust(width)[:width], a.ljust(width)[:width]
    return "".join(m if m != " " else e if e != " " else x for m, e, x in zip(mid, end, line, strict=True))


def test_justified_lines(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab é😀  ") for _ in range(r.randint(0, n)))
    rows = [(i, word(n), word(m), word(k)) for i, (n, m, k) in enumerate([(10, 10, 10), (40, 20, 10), (10, 60, 5), (5, 9, 60), (90, 90, 90), (0, 75, 0)] * 40)]
    got = {x.i: x.t for x in spark.createDataFrame(rows, "i int, a string, b string, c string").select("i", text.justify_line(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()}
    assert got == {i: justified(*parts) for i, *parts in rows}
    none = spark.createDataFrame([(None, "b", "c"), ("a", None, "c"), ("a", "b", None)], "a string, b string, c string")
    assert [x.t for x in none.select(text.justify_line(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == [None] * 3


def test_words_are_looked_at_once(monkeypatch):
    seen = []
    parts = h._parts
    monkeypatch.setattr(h, "_parts", lambda w: seen.append(w) or parts(w))
    lines = h.wrap_lines("once-more twice-told " * 500)
    assert " ".join(lines).replace("- ", "-").split() == ["once-more", "twice-told"] * 500
    assert len(seen) <= 2


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_groups_stay_whole(size):
    keys = [None] * 2 + [""] * 3 + ["a"] * 9 + ["b"] + ["c"] * 4
    rows = pa.table({"k": pa.array(keys, pa.string()), "i": list(range(len(keys)))})
    tables = list(h.whole_groups(iter(rows.to_batches(max_chunksize=size)), "k", 1))
    assert pa.concat_tables(tables).equals(rows)
    groups = [t["k"].to_pylist()[i:j] for t in tables for i, j in itertools.pairwise(h.group_starts(t["k"]))]
    assert groups == [[None] * 2, [""] * 3, ["a"] * 9, ["b"], ["c"] * 4]


def test_pages_and_cells_need_no_frame_for_each_group(spark):
    r = random.Random(2)
    lines = [(d, i, r.choice(["x", " "]), r.choice([None, i // 9]), r.random() < 0.3) for d in (None, 1, 2, 3) for i in range(300)]
    src = spark.createDataFrame(lines, "d long, p long, t string, b long, k boolean")
    got = h.assign_pages(src, doc="d", pos="p", text="t", block="b", keep="k")
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    want = set()
    for d in (None, 1, 2, 3):
        mine = [x for x in lines if x[0] == d]
        want |= {(d, x[1], p) for x, p in zip(mine, h.page_breaks([x[2] == " " for x in mine], [x[3] for x in mine], [x[4] for x in mine]), strict=True)}
    assert {tuple(x) for x in got.collect()} == want
    cells = [(t, i // 5, i % 5, 1 + i % 3, 1 + i % 2) for t in (None, 1, 2) for i in range(40)]
    got = h.place_cells(spark.createDataFrame(cells, "t long, row int, pos int, colspan int, rowspan int"), table="t", row="row", pos="pos")
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    want = {(t, i // 5, i % 5, c) for t in (None, 1, 2) for i, (_, c) in enumerate(h.grid([(x[1], x[3], x[4]) for x in cells if x[0] == t]))}
    assert {tuple(x) for x in got.collect()} == want


def test_a_wide_row_of_cells():
    assert h.grid([(0, 1, 2)] * 20_000 + [(1, 1, 1)]) == [(0, i) for i in range(20_000)] + [(1, 20_000)]


def test_paging_writes_no_tables_and_deals_lines_once(spark, monkeypatch):
    from quire.operators import pages

    rows = [(d, i, i % 10 == 9, None if i % 10 == 9 else f"b{i // 10}", "section" if i % 70 == 0 else "t") for d in range(3) for i in range(500)]
    src = spark.createDataFrame(rows, "doc long, line long, blank boolean, block string, tag string")
    wrote = []
    monkeypatch.setattr(pages, "written", lambda df: wrote.append(df) or df)
    got = pages.paginate(src, doc="doc", line="line", blank="blank", block="block", tag="tag")
    assert got.count() == 1500 and not wrote
    assert plan_of(got).count("Exchange") == 1 and "Join" not in plan_of(got)


def test_lines_leave_their_text_before_they_are_dealt(spark, tmp_path):
    from quire.jobs import text_queries

    texts = ["", " ", "a" * 31 + " " * 29 + "b", "x" * 30 + " ", "y" * 60, "\n".join(["Heading  " * 5, "", "z" * 45] * 9)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = text_queries.text_lines(spark, str(tmp_path))
    want = set()
    for d, t in enumerate(texts):
        at, paras = 0, t.split("\n")
        for p, x in enumerate(paras):
            for k in range(max(-(-len(x) // 30), 1)):
                want.add((d, at, x[30 * k : 30 * k + 30].strip(" ") == "", p, x[:30] if k == 0 and p % 7 == 0 else None))
                at += 1
            if p < len(paras) - 1:
                want.add((d, at, True, None, None))
                at += 1
    assert {(r.doc, r.line, r.blank, r.block, r.title) for r in lines.collect()} == want


def test_no_task_of_the_checks_sorts_what_rules_found(spark):
    from conftest import SF

    from quire.jobs import markup_queries

    plan = plan_of(markup_queries.findings(spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" in plan
    assert "AS found#" not in plan
