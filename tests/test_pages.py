"""Pages against a plain loop over random documents: headings in a row, figures, long gaps, blocks longer than a page."""

from __future__ import annotations

import random

import pytest

from quire.operators import pages


def one_page_after_another(lines: list[tuple[bool, int | None, str | None]], first: int, height: int, few: int, least: int) -> list[int]:
    out, start, page, room = [0] * len(lines), 0, 1, first
    where: dict[int, list[int]] = {}
    for i, (_, b, _) in enumerate(lines):
        if b is not None:
            where.setdefault(b, []).append(i)
    while start < len(lines):
        end = start + room
        if end >= len(lines):
            stop = len(lines)
        else:
            stop, block = end, lines[end][1]
            if block is None:
                at = end
                while at > end - 12:
                    near = [k for k in (at - 1, at - 2, at - 3) if k >= 0 and lines[k][2] == "section"]
                    if not near:
                        break
                    at = near[0]
                stop = at
            else:
                beg, after = where[block][0], where[block][-1] + 1
                left, right, size = end - beg, after - end, after - beg
                kind = lines[beg][2]
                if kind == "section":
                    if sum(lines[k][2] != "section" for k in range(beg, end) if lines[k][1] == block) <= least:
                        stop = beg
                elif kind in pages.WHOLE:
                    if size < height or left <= least:
                        stop = beg
                elif (1 <= left <= few and size > left) or (1 <= right <= few and size > right):
                    stop = beg
            if stop <= start:
                stop = end
        for i in range(start, stop):
            out[i] = page
        start, page, room = stop, page + 1, height
        while start < len(lines) and lines[start][0]:
            start += 1
    return out


def made(r: random.Random, n: int) -> list[tuple[bool, int | None, str | None]]:
    out, block = [], 0
    while len(out) < n:
        block += 1
        kind = r.choice(["t", "t", "figure", "section"])
        if kind == "section":  # headings, then a paragraph that is kept with them
            for _ in range(r.randint(1, 3)):
                out += [(False, block, "section")] * r.randint(1, 2) + [(True, None, None)] * r.randint(0, 2)
            out += [(False, block, "t")] * r.randint(0, 12)
        else:
            out += [(False, block, kind)] * r.choice([1, 2, 3, 5, 9, 20, 47, 60])
        out += [(True, None, None)] * r.choice([1, 1, 1, 2, 150])
    return out[:n]


@pytest.mark.parametrize("shard", [70, 1024])
def test_equals_a_loop(spark, shard):
    r = random.Random(11)
    docs = {i: made(r, r.choice([1, 30, 52, 53, 60, 400, 900])) for i in range(60)} | {99: [(True, None, None)] * 300, 100: [(False, 1, "t")] * 200}
    rows = [(d, i, *x) for d, lines in docs.items() for i, x in enumerate(lines)]
    src = spark.createDataFrame(rows, "doc long, line long, blank boolean, block long, tag string")
    got = pages.paginate(src, doc="doc", line="line", blank="blank", block="block", tag="tag", shard=shard).collect()
    want = {(d, i, p) for d, lines in docs.items() for i, p in enumerate(one_page_after_another(lines, 52, 48, 2, 5))}
    assert {(x.doc, x.line, x.page) for x in got} == want
    assert len(got) == len(rows)
    assert max(p for *_, p in want) > 8


def test_nothing(spark):
    none = spark.createDataFrame([], "doc long, line long, blank boolean, block long, tag string")
    assert pages.paginate(none, doc="doc", line="line", blank="blank", block="block", tag="tag").collect() == []
