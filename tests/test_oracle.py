"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF, duck_rows, rows_of

from quire.jobs import markup_queries, registry, table_queries, text_queries, tree_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names, want = duck_rows(duck, registry.ORACLE[name])
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["lint", "r19_resolve_xrefs", "r34_build_index", "r35_page_ranges", "r43_hierarchical_numbers"])
def test_does_not_depend_on_the_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(rows_of(registry.QUERIES[name](spark, SF)))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
