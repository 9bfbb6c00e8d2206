"""Unique slugs by rounds of claims against the loop that goes name by name."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.functions.helpers import grow_slugs
from quire.operators.windows import unique_slugs


def test_equals_the_loop(spark):
    r = random.Random(2)
    stems = ["x", "", "a" * 31, "a" * 32, "b" * 33, "b" * 36, "c" * 50, "b" * 32 + "-2", "x-2", "c" * 40 + "-3", "d" * 35 + "e" * 5, "d" * 35 + "f" * 9]
    docs = {i: [r.choice(stems) + r.choice(["", "", "a", "b", "-2", "cc"]) for _ in range(r.choice([1, 3, 40, 150]))] for i in range(25)} | {99: ["same"] * 130}
    rows = [(d, i, s) for d, names in docs.items() for i, s in enumerate(names)]
    got = unique_slugs(spark.createDataFrame(rows, "doc long, pos long, s string"), doc="doc", pos="pos", slug=F.col("s")).collect()
    want = {(d, i, s) for d, names in docs.items() for i, s in enumerate(grow_slugs(names))}
    assert {tuple(x) for x in got} == want
    assert len(got) == len(rows)


def test_nothing(spark):
    assert unique_slugs(spark.createDataFrame([], "doc long, pos long, s string"), doc="doc", pos="pos", slug=F.col("s")).collect() == []
