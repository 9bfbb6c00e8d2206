"""How trees are built, cleaned and read: plans that don't grow with what they need not hold."""

from __future__ import annotations

from conftest import SF
from pyspark.sql import functions as F

from quire.jobs import tree_queries
from quire.operators import elements
from quire.operators.joins import scoped_value
from quire.operators.windows import nested_paragraph_numbers
from quire.sources.corpus import explode_elements


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark):
    return explode_elements(spark.createDataFrame([("a", "<r><section><t>x<?set v='1'?></t><ul><li><t/></li></ul></section></r>")], "doc_id string, xml string"))


def test_lines_of_orders_are_not_broadcast(spark, monkeypatch):
    assert "BroadcastHashJoin" not in plan(tree_queries.customer_trees(spark, SF))
    taken = []
    monkeypatch.setattr(tree_queries, "written", lambda df: taken.append(df) or df)
    tree_queries.r26_scoped(spark, SF)
    tree_queries.r15_styles(spark, SF)
    assert len(taken) == 2 and not any("BroadcastHashJoin" in plan(df) for df in taken)


def test_customers_are_dealt_once(spark):
    p = plan(tree_queries.customer_trees(spark, SF))
    assert p.count("Exchange hashpartitioning(doc_id") == 1


def test_subtrees_go_without_joins(spark):
    p = plan(elements.remove_subtrees(some(spark), F.coalesce(F.col("tag") == "ul", F.lit(False))))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1 and p.count("MapInArrow") == 1


def test_each_side_of_a_tree_is_dealt_by_document(spark):
    el = some(spark)
    for df in (scoped_value(el, key="v"), nested_paragraph_numbers(el, el.filter("tag = 'section'").select("doc_id", "node_id", F.lit("section-1").alias("pn"))), elements.convert_lists(el)):
        p = plan(df)
        assert "Exchange hashpartitioning(doc_id" in p and "ENSURE_REQUIREMENTS" not in p


def test_ancestors_have_tags(spark):
    rows = {r.node_id: r for r in some(spark).collect()}
    assert [rows[i].anc_tags for i in range(7)] == [[], ["r"], ["r", "section"], ["r", "section", "t"], ["r", "section"], ["r", "section", "ul"], ["r", "section", "ul", "li"]]
    assert [len(r.anc_ids) == len(r.anc_tags) == r.depth for r in rows.values()] == [True] * 7
