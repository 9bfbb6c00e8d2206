"""Helpers whose result depends on order, against plain loops and invariants."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import helpers as h


@settings(max_examples=150, deadline=None)
@given(st.text("abc de./-", max_size=300), st.integers(10, 60))
def test_wrap_loses_nothing(text, width):
    lines = h.wrap_lines(text, width)
    assert all(len(x) <= width for x in lines)
    assert "".join("".join(lines).split()) == "".join(text.split())


def test_wrap_sentences_and_urls():
    assert h.wrap_lines("It ends. Two e.g. This, One. Three") == ["It ends.  Two e.g. This, One. Three"]  # three letters are an abbreviation
    assert h.wrap_lines("see https://a.example/b-c/d now", 26) == ["see", "https://a.example/b-c/d", "now"]
    assert h.wrap_lines("a Section 3 b", 11) == ["a Section 3", "b"]
    assert h.wrap_lines("and/or one-two", 8) == ["and/or", "one-two"]
    assert h.wrap_lines("x y", 40, indent=2, hang=2) == ["  x y"]
    assert h.wrap_lines("one\u2028two", 40) == ["one", "two"]


def test_sentences():
    ends = ["end.", "end?", "end!)", '"end."', "a1.", "[x].", "word)."]
    assert all(map(h.ends_sentence, ends)) and not any(map(h.ends_sentence, ["", ".", "end", "Fig.", "(Eq.", "e.g.", "[cf.", "i.e.", "-.", "end.)))"]))
    assert h.ends_sentence("FIG.") and h.ends_sentence("Four.") and h.ends_sentence("Fig!")
    assert all(map(h.starts_sentence, ["A", '"A', "([A"])) and not any(map(h.starts_sentence, ["", "a", "1", "\u00c4", "(("]))


def test_where_words_break():
    cut = lambda w: "|".join(h._parts(w))
    assert cut("and/or") == "and/|or" and cut("a/1") == "a/1" and cut("/or") == "/or"
    assert cut("well-known-fact") == "well-|known-|fact" and cut("x-ray") == "x-ray" and cut("2020-12") == "2020-12"
    assert cut("yes--no") == "yes|--|no" and cut("yes--") == "yes--" and cut("--no") == "--no"
    assert cut("one\u200btwo") == "one\u200b|two" and cut("one-\u2060two") == "one-\u2060two"
    assert cut("https://a.example/b-c/dd-ee") == "https://a.example/b-c/dd-ee" and cut("<http://x/yy-zz>") == "<http://x/yy-zz>"
    assert h.wrap_lines("", 10) == [""] and h.wrap_lines("a\u2028\u2028b", 10) == ["a", "", "b"]
    assert h.wrap_lines("one\u200btwo", 4) == ["one", "two"] and h.wrap_lines("12345", 2) == ["12", "34", "5"]


def test_slugs_are_unique_and_grow():
    base = "a" * 50
    got = h.grow_slugs([base] * 12 + ["b", "b"])
    assert got[0] == "a" * 32 and got[8] == "a" * 40 and got[9] == "a" * 40 + "-2" and got[-1] == "b-2"
    assert len(set(got)) == len(got)
    assert h.grow_slugs(["x"] * 120).count(None) == 120 - 99


def test_pages_do_not_fall_and_keep_blocks():
    rng = random.Random(1)
    for _ in range(50):
        block, keep = [], []
        b = 0
        while len(block) < 300:
            n, k = rng.randint(1, 30), rng.random() < 0.3
            block += [b] * n
            keep += [k] * n
            b += 1
        pages = h.page_breaks([False] * len(block), block, keep)
        assert all(0 <= q - p <= 1 for p, q in zip(pages, pages[1:], strict=False)) and pages[0] == 1
        for p in set(pages):
            assert pages.count(p) <= (52 if p == 1 else 48)
        for x in set(block):
            at = [i for i, y in enumerate(block) if y == x]
            if keep[at[0]] and at[0] > 0:
                assert len({pages[i] for i in at}) == 1


def test_pages_drop_blank_tops():
    blank = [False] * 52 + [True] * 2 + [False] * 3
    pages = h.page_breaks(blank, [None] * 57, [False] * 57)
    assert pages[51] == 1 and pages[52:54] == [0, 0] and pages[54] == 2


def test_grid_under_spans():
    assert h.grid([(0, 2, 1), (0, 1, 2), (1, 1, 1), (1, 1, 1), (2, 1, 1)]) == [(0, 0), (0, 2), (1, 0), (1, 1), (2, 0)]


def test_fetches():
    assert h.fetches([0, 5, 10, 11, 30], 10) == [True, False, False, True, True]
    assert h.fetches([5], 10, last=0) == [False]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 3), st.integers(1, 3)), max_size=25))
def test_grid_takes_the_first_free_place(cells):
    cells = sorted(cells, key=lambda c: c[0])
    placed = h.grid(cells)
    covers = lambda k, row, col: placed[k][0] <= row < placed[k][0] + cells[k][2] and placed[k][1] <= col < placed[k][1] + cells[k][1]
    for k, (row, col) in enumerate(placed):
        assert row == cells[k][0]
        assert not any(covers(j, row, col) for j in range(k))
        assert all(any(covers(j, row, c) for j in range(k)) for c in range(col))


def test_names_come_in_pieces(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    texts = ["ab", None, "", "é\x07"] * 6
    parts = list(h.in_pieces(pd.Series(texts, dtype=object), str.upper, most=5))
    assert len(parts) > 3 and [x for p in parts for x in p] == [None if x is None else x.upper() for x in texts]
    assert list(h.in_pieces(pd.Series([], dtype=object), str.upper)) == []
    # no series of results is longer than what about a million characters give, whatever a batch holds
    sizes = [sum(map(len, p)) for p in h.in_pieces(pd.Series(["x" * 100_000] * 60), lambda x: x * 20)]
    assert len(sizes) == 6 and max(sizes) == 20_000_000
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["ab", None, "", "\x07", "x" * 700_000, "y" * 700_000, "z"])], "i int, t string").coalesce(1)
    got = {r.i: r.n for r in rows.select("i", h.character_names(F.col("t")).alias("n")).collect()}
    assert got[0] == "LATIN SMALL LETTER A, LATIN SMALL LETTER B" and got[1] is None and got[2] == "" and got[3] == "U+0007"
    assert got[5] == ", ".join(["LATIN SMALL LETTER Y"] * 700_000) and got[6] == "LATIN SMALL LETTER Z"
