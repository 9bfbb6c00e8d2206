"""Joins, groupings and numberings over the given star schema, each with the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fields, text
from quire.functions.helpers import place_cells
from quire.jobs.folders import shared_folder
from quire.jobs.registry import query, table
from quire.operators import aggregates as A
from quire.operators import elements as E
from quire.operators import joins as J
from quire.operators import windows as V
from quire.streaming.jobs import fetch_job, fresh_fetches_batch


def attrs_text(c: str) -> F.Column:
    """A map as text, in order of its keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def part_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Parts as elements: tag by brand, with a type (not for every third) and a size (for even keys)."""
    p = table(spark, d, "part")
    both = F.map_from_entries(F.array_compact(F.array(F.when(F.col("p_partkey") % 3 != 0, F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v"))), F.when(F.col("p_partkey") % 2 == 0, F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v"))))))
    return p.select("p_partkey", F.col("p_brand").alias("tag"), both.alias("attrs"))


def brand_defaults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("tag")).distinct().withColumn("defaults", F.create_map(F.lit("type"), F.lit("SMALL"), F.lit("size"), F.lit("7"), F.lit("grade"), F.col("tag")))


@query("r09_fill_attr_defaults", """
SELECT p_partkey, 'grade=' || p_brand || ';size=' || (CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '7' END) || ';type=' || (CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE 'SMALL' END) AS attrs FROM part""")
def r09(spark: SparkSession, d: str) -> DataFrame:
    return E.fill_attr_defaults(part_attrs(spark, d), brand_defaults(spark, d)).select("p_partkey", attrs_text("attrs").alias("attrs"))


@query("r10_strip_attr_defaults", """
SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 2 = 0 AND p_size <> 7 THEN 'size=' || p_size END, CASE WHEN p_partkey % 3 <> 0 AND p_type <> 'SMALL' THEN 'type=' || p_type END) AS attrs FROM part""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return E.strip_attr_defaults(part_attrs(spark, d), brand_defaults(spark, d)).select("p_partkey", attrs_text("attrs").alias("attrs"))


@query("r12_yes_no_to_bool", """
SELECT event_id, 'flag=' || (CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'maybe' END) || ';k=' || regexp_extract(props, '[0-9]+') AS attrs FROM events""")
def r12(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 3 == 0, "yes").when(F.col("event_id") % 3 == 1, "no").otherwise("maybe")
    ev = table(spark, d, "events").select("event_id", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("flag"), flag)).alias("attrs"))
    return E.yes_no_to_bool(ev).select("event_id", attrs_text("attrs").alias("attrs"))


@query("r13_clean_attrs", "SELECT p_partkey, 'brand=' || p_brand || ';keep=  x ;title=' || p_name AS attrs FROM part")
def r13(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("name"), F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit("brand"), F.concat("p_brand", F.lit("  ")), F.lit("keep"), F.lit("  x ")).alias("attrs"))
    return E.clean_attrs(p, rename={"name": "title"}, keep_space=["keep"]).select("p_partkey", attrs_text("attrs").alias("attrs"))


@query("r14_check_typed_attrs", """
SELECT event_id, 'k' AS attr, regexp_extract(props, '[0-9]+') || 'x' AS value FROM events WHERE event_id % 10 = 0""")
def r14(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "map<string,string>")["k"]
    ev = table(spark, d, "events").select("event_id", F.create_map(F.lit("k"), F.when(F.col("event_id") % 10 == 0, F.concat(k, F.lit("x"))).when(F.col("event_id") % 10 == 1, "auto").otherwise(k), F.lit("name"), F.lit("abc")).alias("attrs"))
    return E.check_typed_attrs(ev, {"k": "auto", "absent": None}).select("event_id", "attr", "value")


@query("r94_redundant_pairs", """
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Ωμέγα' WHEN 2 THEN NULL ELSE 'é' || p_name END AS n, CASE p_partkey % 4 WHEN 1 THEN NULL ELSE p_name END AS a FROM part)
SELECT p_partkey, CASE WHEN n = a THEN 'warning' ELSE 'error' END AS severity, CASE WHEN n = a THEN 'redundant' WHEN n IS NULL THEN 'orphan' ELSE 'missing' END AS code, 'asciiName' AS attr FROM p WHERE n = a OR n IS NULL OR a IS NULL""")
def r94(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    n = F.when(m == 0, F.col("p_name")).when(m == 1, "Ωμέγα").when(m == 3, F.concat(F.lit("é"), "p_name"))
    p = table(spark, d, "part").select("p_partkey", F.map_filter(F.create_map(F.lit("name"), n, F.lit("asciiName"), F.when(m != 1, F.col("p_name"))), lambda k, v: v.isNotNull()).alias("attrs"))
    return E.redundant_pairs(p, {"name": "asciiName"})[1].select("p_partkey", "severity", "code", "attr")


@query("r93_insert_missing", """
WITH w AS (SELECT n_name AS doc, k AS kind FROM nation, (SELECT unnest(['DOI', 'ISSN', 'REGION']) AS k)), h AS (
  SELECT n_name AS doc, CASE WHEN n_nationkey % 2 = 0 THEN 'DOI' ELSE 'REGION' END AS kind, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT w.doc, w.kind, h.value FROM w LEFT JOIN h ON w.doc = h.doc AND w.kind = h.kind""")
def r93(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    rows = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("doc"), F.when(F.col("n_nationkey") % 2 == 0, "DOI").otherwise("REGION").alias("kind"), F.col("r_name").alias("value"))
    return J.insert_missing(rows, n, spark.createDataFrame([("DOI",), ("ISSN",), ("REGION",)], "kind string"), key="n_name", kind="kind", doc="doc")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of an order: parts as anchors, suppliers as pns, sums of both as slugs."""
    l = table(spark, d, "lineitem")
    pick = lambda c, kind: l.select(F.col("l_orderkey").alias("doc_id"), c.cast("string").alias("id"), F.lit(kind).alias("id_kind"), F.col("l_linenumber").alias("node_id"))
    return pick(F.col("l_partkey") % 20, "anchor").unionByName(pick(F.col("l_suppkey") % 30, "pn")).unionByName(pick((F.col("l_partkey") + F.col("l_suppkey")) % 40, "slug"))


@query("r19_resolve_xrefs", """
WITH i AS (SELECT l_orderkey AS d, CAST(l_partkey % 20 AS VARCHAR) AS id, 0 AS r, 'anchor' AS kind, l_linenumber AS n FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_suppkey % 30 AS VARCHAR), 1, 'pn', l_linenumber FROM lineitem
  UNION ALL SELECT l_orderkey, CAST((l_partkey + l_suppkey) % 40 AS VARCHAR), 2, 'slug', l_linenumber FROM lineitem), b AS (
  SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY d, id ORDER BY r, n) = 1)
SELECT o_orderkey AS doc_id, CAST(o_custkey % 40 AS VARCHAR) AS target, b.kind AS id_kind, b.n AS node_id FROM orders LEFT JOIN b ON b.d = o_orderkey AND b.id = CAST(o_custkey % 40 AS VARCHAR)""")
def r19(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 40).cast("string").alias("target"))
    return J.resolve_xrefs(x, _ids(spark, d))


@query("r20_unresolved_xrefs", "SELECT o_orderkey, target FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS target FROM orders) WHERE target NOT IN (SELECT c_custkey FROM customer)")
def r20(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return J.unresolved(table(spark, d, "orders").select("o_orderkey", target.alias("target")), table(spark, d, "customer"), on={"target": "c_custkey"})


@query("r21_unused_references", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey - l_partkey % 2 FROM lineitem)")
def r21(spark: SparkSession, d: str) -> DataFrame:
    return J.unused_references(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 2).alias("l_partkey")), on={"p_partkey": "l_partkey"})


@query("r22_derive_xref_content", """
WITH x AS (SELECT l_orderkey, l_linenumber, ['default', 'counter', 'title', 'none'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS f, ['reference', 'section', 't'][CAST(l_partkey % 3 + 1 AS INTEGER)] AS k, l_suppkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN f = 'none' THEN '' WHEN f = 'counter' THEN CAST(l_suppkey AS VARCHAR) WHEN f = 'title' THEN p_name WHEN k = 'reference' THEN p_brand WHEN k = 'section' THEN 'Section ' || l_suppkey ELSE p_name END AS content FROM x""")
def r22(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    fmt = F.get(F.array(*map(F.lit, ("default", "counter", "title", "none"))), F.col("l_linenumber") % 4)
    kind = F.get(F.array(*map(F.lit, ("reference", "section", "t"))), (F.col("l_partkey") % 3).cast("int"))
    null = F.lit(None).cast("string")
    return rows.select("l_orderkey", "l_linenumber", J.derive_xref_content(fmt, kind, F.col("l_suppkey").cast("string"), F.col("p_name"), null, F.col("p_brand")).alias("content"))


@query("r23_display_names", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Alias-' || (s_suppkey % 12) ELSE s_name END AS display, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS VARCHAR) AS num,
  coalesce(s_suppkey % 3 = 0 AND count(*) FILTER (WHERE s_suppkey % 3 = 0) OVER (PARTITION BY s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 12 END) > 1, FALSE) AS dup FROM supplier""")
def r23(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("doc_id"), F.col("s_name").alias("anchor"))
    shown = s.filter("s_suppkey % 3 = 0").select("doc_id", F.col("anchor").alias("target"), F.concat(F.lit("Alias-"), F.col("s_suppkey") % 12).alias("to"))
    named = J.display_names(s, shown, pos="s_suppkey")
    num = J.display_names(s, shown, pos="s_suppkey", symbolic=False).select("s_suppkey", F.col("display").alias("num"))
    dup = J.duplicate_displays(shown).select("doc_id", F.col("to").alias("display"), F.lit(True).alias("dup"))
    return named.join(num, "s_suppkey").join(dup, ["doc_id", "display"], "left").select("s_suppkey", "display", "num", F.coalesce("dup", F.lit(False)).alias("dup"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as one tree of elements: ids are prefixed numbers, the path runs from the top to the node."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    doc = F.lit("d")
    rid, nid, sid = F.col("r_regionkey") + 1, F.col("n_nationkey") + 1001, F.col("s_suppkey") + 100001
    top = r.select(doc.alias("doc_id"), rid.cast("long").alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.array(rid.cast("long")).alias("path"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") > 2, "back").otherwise("middle").alias("part"), F.col("r_regionkey").cast("long").alias("k"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    mid = nr.select(doc.alias("doc_id"), nid.cast("long").alias("node_id"), rid.cast("long").alias("parent_id"), F.array(rid.cast("long"), nid.cast("long")).alias("path"), F.col("n_name").alias("name"), F.when(F.col("r_regionkey") > 2, "back").otherwise("middle").alias("part"), F.col("n_nationkey").cast("long").alias("k"))
    low = s.join(nr, F.col("s_nationkey") == F.col("n_nationkey")).select(doc.alias("doc_id"), sid.cast("long").alias("node_id"), nid.cast("long").alias("parent_id"), F.array(rid.cast("long"), nid.cast("long"), sid.cast("long")).alias("path"), F.col("s_name").alias("name"), F.when(F.col("r_regionkey") > 2, "back").otherwise("middle").alias("part"), F.col("s_suppkey").cast("long").alias("k"))
    return top.unionByName(mid).unionByName(low)


TREE = """
t0 AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS node_id, row_number() OVER (PARTITION BY r_regionkey > 2 ORDER BY r_regionkey) AS a, 0 AS b, 0 AS c, r_regionkey > 2 AS back, r_name AS name, 1 AS depth, r_regionkey AS rk, NULL AS nk FROM region),
t1 AS (SELECT CAST(n_nationkey + 1001 AS BIGINT) AS node_id, t0.a, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b, 0 AS c, t0.back, n_name AS name, 2 AS depth, n_regionkey AS rk, n_nationkey AS nk FROM nation JOIN t0 ON t0.node_id = n_regionkey + 1),
t2 AS (SELECT CAST(s_suppkey + 100001 AS BIGINT) AS node_id, t1.a, t1.b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS c, t1.back, s_name AS name, 3 AS depth, t1.rk, t1.nk FROM supplier JOIN t1 ON t1.node_id = s_nationkey + 1001),
t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2),
numbered AS (SELECT *, (CASE WHEN back THEN chr(CAST(96 + a AS INTEGER)) ELSE CAST(a AS VARCHAR) END) || (CASE WHEN depth > 1 THEN '.' || b ELSE '' END) || (CASE WHEN depth > 2 THEN '.' || c ELSE '' END) AS number FROM t)"""


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return V.hierarchical_numbers(tree(spark, d), doc="doc_id", node="node_id", path="path", part="part", sib="k", parent="parent_id")


@query("r43_hierarchical_numbers", f"WITH {TREE} SELECT node_id, number FROM numbered")
def r43(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).select("node_id", "number")


@query("r25_nearest_ancestor", f"WITH {TREE} SELECT node_id, CASE WHEN depth = 3 AND nk % 2 = 0 THEN 'NATION_' || nk WHEN depth > 1 THEN (SELECT r_name FROM region WHERE r_regionkey = rk) ELSE 'none' END AS style FROM t")
def r25(spark: SparkSession, d: str) -> DataFrame:
    el = tree(spark, d).select("doc_id", "node_id", F.slice("path", 1, F.size("path") - 1).alias("anc_ids"), F.size("path").alias("depth"), "name", "k")
    decisive = el.filter("depth = 1 OR (depth = 2 AND k % 2 = 0)").withColumnRenamed("name", "style")
    return J.nearest_ancestor(el, decisive, value="style", default=F.lit("none")).select("node_id", "style")


@query("r51_toc_visibility", f"""WITH {TREE}, m AS (SELECT *, CASE WHEN depth = 2 AND nk % 5 = 0 THEN 'exclude' WHEN depth = 3 AND node_id % 9 = 0 THEN 'include' END AS mark FROM t)
SELECT node_id, CASE WHEN mark = 'include' OR (depth = 1 AND rk IN (SELECT rk FROM m WHERE mark = 'include')) OR (depth = 2 AND nk IN (SELECT nk FROM m WHERE mark = 'include')) THEN TRUE
  WHEN nk IS NOT NULL AND nk % 5 = 0 AND depth >= 2 THEN FALSE ELSE depth <= 2 END AS visible FROM m""")
def r51(spark: SparkSession, d: str) -> DataFrame:
    depth = F.size("path")
    mark = F.when((depth == 2) & (F.col("k") % 5 == 0), "exclude").when((depth == 3) & (F.col("node_id") % 9 == 0), "include")
    return V.toc_visibility(tree(spark, d).withColumn("mark", mark), doc="doc_id", node="node_id", path="path", mark="mark", depth=2).select("node_id", "visible")


@query("r56_table_of_contents", f"""WITH {TREE}
SELECT row_number() OVER (ORDER BY back, a, b, c) AS rank, repeat('  ', depth - 1) || (CASE WHEN back THEN 'Appendix ' || upper(number) ELSE number END) || '. ' || name || ' ' || (1 + node_id % 50) AS line FROM numbered WHERE depth <= 2""")
def r56(spark: SparkSession, d: str) -> DataFrame:
    s = numbered(spark, d).withColumn("visible", F.size("path") <= 2)
    key = F.struct((F.col("part") == "back").alias("b"), F.transform(F.split("number", r"\."), lambda x: F.lpad(x, 6, "0")))
    return V.table_of_contents(s, doc="doc_id", pos=key, number="number", title="name", level=F.size("path"), appendix=F.col("part") == "back", page=1 + F.col("node_id") % 50).select("rank", "line")


@query("r72_section_fields", f"""WITH {TREE}, p AS (SELECT node_id, 'section-' || (CASE WHEN back THEN 'appendix.' || number ELSE number END) || (CASE WHEN depth = 3 THEN '-7' ELSE '' END) AS pn, number, depth, back FROM numbered)
SELECT pn, 'section' AS kind, number AS section, CASE WHEN depth = 3 THEN '7' END AS paragraph, CAST(depth AS BIGINT) AS level, back AS appendix,
  CASE WHEN back THEN 'appendix-' || upper(substr(number, 1, 1)) || substr(number, 2) || (CASE WHEN depth = 3 THEN '-7' ELSE '' END) ELSE pn END AS fragment FROM p""")
def r72(spark: SparkSession, d: str) -> DataFrame:
    pn = F.concat(F.lit("section-"), F.when(F.col("part") == "back", F.lit("appendix.")).otherwise(""), "number", F.when(F.size("path") == 3, "-7").otherwise(""))
    s = numbered(spark, d).select(pn.alias("pn")).withColumn("s", fields.split_pn(F.col("pn")))
    return s.select("pn", "s.kind", "s.section", "s.paragraph", fields.section_level(F.col("s.section")).cast("long").alias("level"), fields.is_appendix(F.col("pn")).alias("appendix"), fields.fragment_id(F.col("pn")).alias("fragment"))


@query("r26_value_in_force", """
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS in_force FROM events""")
def r26(spark: SparkSession, d: str) -> DataFrame:
    return J.value_in_force(table(spark, d, "events"), by="user_id", order=["ts", "event_id"], value=F.when(F.col("event_type") == "click", F.col("value")), name="in_force").select("event_id", "in_force")


@query("r27_select_boilerplate", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'Final ' || o_orderkey || ' for ' || o_custkey WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'Open: ' || o_custkey END AS text FROM orders""")
def r27(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("F", "1-URGENT", "Final {number} for {group}"), ("O", "5-LOW", "Open: {group}")], "o_orderstatus string, o_orderpriority string, text string")
    return J.select_boilerplate(table(spark, d, "orders"), rules, on=["o_orderstatus", "o_orderpriority"], fill={"number": F.col("o_orderkey"), "group": F.col("o_custkey")}).select("o_orderkey", "text")


@query("r28_effective_dated", """
SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '2000-06-01' THEN '5.0' WHEN o_orderdate >= DATE '1998-09-12' THEN '3.0' WHEN o_orderdate >= DATE '1996-02-15' THEN '2.0' END AS version FROM orders""")
def r28(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("1996-02-15", "1998-09-12", "2.0"), ("1998-09-12", "2000-06-01", "3.0"), ("2000-06-01", None, "5.0")], "since string, until string, version string")
    v = v.select(F.to_date("since").alias("since"), F.to_date("until").alias("until"), "version")
    return J.effective_dated(table(spark, d, "orders"), v, date="o_orderdate").select("o_orderkey", "version")


@query("r30_country_lookup", """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'N' || n_nationkey WHEN 1 THEN 'N' || n_nationkey WHEN 2 THEN 'N1' END AS code FROM nation""")
def r30(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    m = F.col("n_nationkey") % 4
    asked = n.select("n_nationkey", F.when(m == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(m == 1, F.concat(F.lit("n"), "n_nationkey")).when(m == 2, "Old land").otherwise("Nowhere").alias("country"))
    return J.country_lookup(asked, n.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name")), spark.createDataFrame([("OLD LAND", "NATION_1")], "alias string, name string"), name="country").select("n_nationkey", "code")


@query("r31_relations", """
WITH e AS (SELECT DISTINCT l_orderkey AS doc, 'obsoletes' AS relation, CAST(l_partkey AS VARCHAR) AS target FROM lineitem)
SELECT target, relation, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS sources FROM e GROUP BY target, relation""")
def r31(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), " , "), F.lit(", ,")).alias("obsoletes"))
    return J.reverse_relations(J.relation_edges(docs, {"obsoletes": "obsoletes"}, doc="l_orderkey"), doc="l_orderkey").select("target", "relation", F.array_join("sources", ",").alias("sources"))


@query("r34_build_index", """
WITH e AS (SELECT p_partkey // 100 AS doc, CASE WHEN p_partkey % 11 = 0 THEN '(' || p_name ELSE p_name END AS item, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS sub, p_brand AS anchor, p_partkey AS pos, p_partkey % 13 = 0 AS prime FROM part),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc, item, anchor ORDER BY pos) = 1),
g AS (SELECT doc, upper(substr(item, 1, 1)) AS letter, item, sub, string_agg(anchor || (CASE WHEN prime THEN '*' ELSE '' END), ' ' ORDER BY pos) AS anchors FROM f GROUP BY ALL)
SELECT doc, letter, item, sub, anchors, row_number() OVER (PARTITION BY doc ORDER BY regexp_matches(item, '^[a-zA-Z0-9]'), letter, lower(item), item, lower(sub), sub) AS rank FROM g""")
def r34(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("doc"), F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("("), "p_name")).otherwise(F.col("p_name")).alias("item"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("sub"), F.col("p_brand").alias("anchor"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 13 == 0).alias("prime"))
    return A.build_index(e, doc="doc", item="item", sub="sub", anchor="anchor", pos="pos", primary="prime").withColumn("anchors", F.array_join("anchors", " "))


@query("r35_page_ranges", """
WITH d AS (SELECT DISTINCT l_partkey % 300 AS k, CAST(l_quantity AS INTEGER) AS p FROM lineitem), g AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM d),
r AS (SELECT k, min(p) AS a, max(p) AS b FROM g GROUP BY k, g)
SELECT k, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY k""")
def r35(spark: SparkSession, d: str) -> DataFrame:
    return A.page_ranges(table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("k"), "l_quantity"), by=["k"], page="l_quantity")


CELLS = "SELECT l_orderkey % 200 AS tab, l_orderkey // 200 AS row, l_linenumber AS pos, 1 + l_suppkey % 3 AS colspan, 1 + l_partkey % 2 AS rowspan FROM lineitem"


def cells(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select((F.col("l_orderkey") % 200).alias("tab"), F.floor(F.col("l_orderkey") / 200).alias("row"), F.col("l_linenumber").alias("pos"), (1 + F.col("l_suppkey") % 3).alias("colspan"), (1 + F.col("l_partkey") % 2).alias("rowspan"))


@query("r36_table_dimensions", f"""WITH c AS ({CELLS}), r AS (SELECT tab, row, sum(colspan) AS w, max(rowspan) AS h FROM c GROUP BY tab, row)
SELECT tab, CAST(count(*) + max_by(h, row) - 1 AS BIGINT) AS n_rows, CAST(max(w) AS BIGINT) AS n_cols FROM r GROUP BY tab""")
def r36(spark: SparkSession, d: str) -> DataFrame:
    return A.table_dimensions(cells(spark, d), table="tab", row="row")


@query("r37_column_min_widths", """
WITH m AS (SELECT p_brand AS tab, p_size % 4 AS col, CAST(max(floor(list_max(list_transform(string_split(p_name, ' '), lambda w: length(w))) / (1.0 + p_partkey % 2))) AS BIGINT) AS min_width FROM part GROUP BY ALL),
r AS (SELECT *, sum(min_width) OVER (PARTITION BY tab) AS s, row_number() OVER (PARTITION BY tab ORDER BY min_width DESC, col) AS k FROM m)
SELECT tab, col, min_width, CAST(min_width + CASE WHEN 32 - s - 2 * (k - 1) > 2 THEN 2 ELSE 0 END AS BIGINT) AS width FROM r""")
def r37(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_brand").alias("tab"), (F.col("p_size") % 4).alias("col"), "p_name", (1 + F.col("p_partkey") % 2).alias("colspan"))
    return A.pad_columns(A.column_min_widths(c, table="tab", col="col", text="p_name"), table="tab", col="col", width=32)


@query("r38_author_list", """
WITH a AS (SELECT c_nationkey, c_custkey // 400 AS g, c_custkey AS pos, replace(c_name, 'Customer#', 'C') || ', ' || substr(c_mktsegment, 1, 1) || '.' AS first, substr(c_mktsegment, 1, 1) || '. ' || replace(c_name, 'Customer#', 'C') AS last, c_custkey % 5 = 0 AS ed FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, g ORDER BY pos) AS i, count(*) OVER (PARTITION BY c_nationkey, g) AS n FROM a)
SELECT c_nationkey, g, string_agg((CASE WHEN i = n AND n > 1 THEN 'and ' || last ELSE first END) || (CASE WHEN ed THEN ', Ed.' ELSE '' END) || (CASE WHEN n = 2 AND i = 1 THEN ' ' WHEN i < n THEN ', ' ELSE '' END), '' ORDER BY i) AS authors FROM n GROUP BY ALL""")
def r38(spark: SparkSession, d: str) -> DataFrame:
    sur, ini, null = F.replace("c_name", F.lit("Customer#"), F.lit("C")), F.substring("c_mktsegment", 1, 1), F.lit(None).cast("string")
    rows = table(spark, d, "customer").withColumn("g", F.floor(F.col("c_custkey") / 400))
    return A.author_list(rows, by=["c_nationkey", "g"], pos="c_custkey", first=fields.ref_name_first(ini, sur, null, null), last=fields.ref_name_last(ini, sur, null, null), editor=F.col("c_custkey") % 5 == 0)


@query("r42_inconsistent_values", """
SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS vals FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1""")
def r42(spark: SparkSession, d: str) -> DataFrame:
    return A.inconsistent_values(table(spark, d, "lineitem"), key="l_orderkey", col="l_returnflag")


@query("r42_fill_agreed", """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END AS flag FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(flag, CASE WHEN min(flag) OVER (PARTITION BY l_orderkey) = max(flag) OVER (PARTITION BY l_orderkey) THEN min(flag) OVER (PARTITION BY l_orderkey) END) AS flag FROM l""")
def r42b(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")).alias("flag"))
    return A.fill_agreed(rows, key="l_orderkey", col="flag")


@query("r46_list_counters", """
WITH l AS (SELECT o_custkey AS grp, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 10 END AS start, 1 + o_orderkey % 3 AS n FROM orders), s AS (SELECT *, count(start) OVER (PARTITION BY grp ORDER BY pos) AS seg FROM l)
SELECT grp, pos, CAST(coalesce(max(start) OVER (PARTITION BY grp, seg), 1) + coalesce(sum(n) OVER (PARTITION BY grp, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM s""")
def r46(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.lit(0).alias("doc"), F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 4 == 0, 10).alias("start"), (1 + F.col("o_orderkey") % 3).alias("n"))
    return V.list_counters(o, doc="doc", group="grp", pos="pos", start="start", n_items="n").select("grp", "pos", "first")


@query("r47_unique_slugs_fast", """
WITH s AS (SELECT p_brand, p_partkey, replace(p_name, ' ', '-') AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, s ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM n""")
def r47(spark: SparkSession, d: str) -> DataFrame:
    return V.unique_slugs_fast(table(spark, d, "part"), doc="p_brand", pos="p_partkey", slug=text.slugify(F.col("p_name"), "name")).select("p_partkey", "slug")


@query("r47_unique_slugs", """
WITH RECURSIVE s AS (SELECT p_partkey // 500 AS doc, p_partkey, replace(p_name || ' of the larger kind ' || p_partkey % 7 || ' ' || p_partkey % 3, ' ', '-') AS s FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY p_partkey) AS i, greatest(32, least(40, length(s))) AS m FROM s),
c AS (SELECT *, list_concat(list_transform(range(32, m + 1), lambda k: substr(s, 1, k)), list_transform(range(2, 100), lambda k: substr(s, 1, m) || '-' || k)) AS cands FROM n),
g AS (
  SELECT doc, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS slug, CAST(NULL AS BIGINT) AS p_partkey FROM (SELECT DISTINCT doc FROM n)
  UNION ALL SELECT doc, i, CASE WHEN slug IS NULL THEN seen ELSE list_append(seen, slug) END, slug, p_partkey FROM (
    SELECT g.doc, g.i + 1 AS i, g.seen, list_filter(c.cands, lambda x: NOT list_contains(g.seen, x))[1] AS slug, c.p_partkey FROM g JOIN c ON c.doc = g.doc AND c.i = g.i + 1))
SELECT p_partkey, slug FROM g WHERE i > 0""")
def r47b(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 500 parts, whose names get long enough to grow."""
    name = F.concat("p_name", F.lit(" of the larger kind "), F.col("p_partkey") % 7, F.lit(" "), F.col("p_partkey") % 3)
    parts = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 500).alias("doc"), "p_partkey", name.alias("name"))
    return V.unique_slugs(parts, doc="doc", pos="p_partkey", slug=text.slugify(F.col("name"), "name")).select("p_partkey", "slug")


@query("r48_unnumbered_order", """
SELECT o_orderkey FROM (SELECT *, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders) WHERE b = 1 AND o_orderstatus <> 'P'""")
def r48(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("numbered", F.col("o_orderstatus") != "P")
    return V.unnumbered_order(o, doc="o_custkey", parent="o_custkey", pos="o_orderkey", numbered="numbered").select("o_orderkey")


@query("r48_unnumbered_parents", """
WITH s AS (SELECT o_orderkey AS node, o_orderkey // 1000 AS doc, CASE WHEN o_orderkey % 1000 > 0 THEN o_orderkey - o_orderkey % 1000 + (o_orderkey % 1000) // 3 END AS parent, o_orderstatus <> 'P' AS numbered FROM orders)
SELECT s.doc, s.node FROM s JOIN s AS p ON s.doc = p.doc AND s.parent = p.node WHERE s.numbered AND NOT p.numbered""")
def r48b(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the sections of trees of a thousand."""
    at = F.col("o_orderkey") % 1000
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 1000").alias("doc"), F.when(at > 0, F.col("o_orderkey") - at + F.expr("(o_orderkey % 1000) div 3")).alias("parent"), (F.col("o_orderstatus") != "P").alias("numbered"))
    return V.unnumbered_parents(s, doc="doc", node="node", parent="parent", numbered="numbered").select("doc", "node")


@query("r49_keep_with_previous", """
SELECT event_id, coalesce(lead(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS keep_with_next FROM events""")
def r49(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return V.keep_with_previous(ev, by=["user_id"], pos="at", flag=F.col("event_type") == "error").select("event_id", "keep_with_next")


@query("r52_index_numbers", """
SELECT p_partkey, 'iref-' || replace(p_name, ' ', '-') || (CASE WHEN p_size % 2 = 0 THEN '-' || lower(p_type) ELSE '' END) || '-' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pn FROM part""")
def r52(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("sub", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))
    return V.index_numbers(p, doc="p_brand", pos="p_partkey", item="p_name", sub="sub", slug=lambda c: text.slugify(c, "name")).select("p_partkey", "pn")


@query("r54_sort_references", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY upper(substr(s_name, 18)), s_suppkey) AS rank FROM supplier")
def r54(spark: SparkSession, d: str) -> DataFrame:
    return V.sort_references(table(spark, d, "supplier"), doc="s_nationkey", name=F.substring("s_name", 18, 99), pos="s_suppkey").select("s_suppkey", "rank")


SERIES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'DOI' WHEN '2-HIGH' THEN 'RFC' WHEN '3-MEDIUM' THEN 'STD' ELSE o_orderpriority END"


@query("r55_sort_series", f"""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE {SERIES} WHEN 'STD' THEN 1 WHEN 'RFC' THEN 4 WHEN 'DOI' THEN 5 ELSE 6 END, o_orderkey) AS rank FROM orders""")
def r55(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("series", F.expr(SERIES))
    return V.sort_series(o, by=["o_custkey"], name="series", pos="o_orderkey").select("o_orderkey", "rank")


@query("r55_pick_target", f"""
SELECT o_custkey, arg_min((CASE WHEN {SERIES} = 'DOI' THEN 'https://doi.example/' ELSE 'https://rfc.example/' END) || o_orderkey, o_orderkey) AS target FROM orders WHERE {SERIES} IN ('DOI', 'RFC') GROUP BY o_custkey""")
def r55b(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("series", F.expr(SERIES)).withColumn("value", F.col("o_orderkey").cast("string"))
    return V.pick_target(o, by=["o_custkey"], name="series", value="value", pos="o_orderkey", base={"DOI": "https://doi.example/", "RFC": "https://rfc.example/"})


@query("r57_pick_artset_anchor", """
WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT 'p' || l_partkey)) AS a FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a[1] AS anchor, array_to_string(a[2:], ',') AS dropped FROM g""")
def r57(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("anchor", F.concat(F.lit("p"), "l_partkey"))
    return V.pick_artset_anchor(l, by="l_orderkey", anchor="anchor").withColumn("dropped", F.array_join("dropped", ","))


@query("r68_names", """
WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'J' WHEN 1 THEN 'Ж' WHEN 2 THEN 'A.B.' END AS i, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS s, CASE WHEN c_custkey % 4 = 3 THEN (CASE WHEN c_custkey % 8 = 3 THEN 'mary ann ' || c_mktsegment ELSE 'Ωμέγα Ψ' END) END AS f FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'J. ' || s WHEN 1 THEN 'Ж ' || s WHEN 2 THEN 'A.B. ' || s ELSE (CASE WHEN c_custkey % 8 = 3 THEN 'M. A. ' || substr(f, 10) ELSE f END) END AS short,
  CASE c_custkey % 4 WHEN 0 THEN 'J. ' || s WHEN 1 THEN 'Ж ' || s WHEN 2 THEN 'A.B. ' || s ELSE f END AS full_name,
  CASE c_custkey % 4 WHEN 0 THEN s || ', J.' WHEN 1 THEN s || ', Ж' WHEN 2 THEN s || ', A.B.' ELSE (CASE WHEN c_custkey % 8 = 3 THEN substr(f, 10) || ', M. A.' ELSE f END) END AS ref_first,
  CASE c_custkey % 4 WHEN 0 THEN 'J. ' || s WHEN 1 THEN 'Ж ' || s WHEN 2 THEN 'A. ' || s ELSE (CASE WHEN c_custkey % 8 = 3 THEN 'M. A. ' || substr(f, 10) ELSE f END) END AS old FROM n""")
def r68(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 4
    i = F.when(m == 0, "J").when(m == 1, "Ж").when(m == 2, "A.B.")
    s, f = F.when(m < 3, F.col("c_name")), F.when(m == 3, F.when(F.col("c_custkey") % 8 == 3, F.concat(F.lit("mary ann "), "c_mktsegment")).otherwise("Ωμέγα Ψ"))
    return table(spark, d, "customer").select("c_custkey", fields.short_name(i, s, f).alias("short"), fields.full_name(i, s, f).alias("full_name"), fields.ref_name_first(i, s, f, F.lit("Org")).alias("ref_first"), fields.short_name(i, s, f, F.lit("1272")).alias("old"))


@query("r70_dates", """
WITH d AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS m, CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE CAST(day(o_orderdate) AS INTEGER) END AS dd, o_orderdate FROM orders)
SELECT o_orderkey, y || (CASE WHEN m IS NULL THEN '' ELSE '-' || lpad(CAST(m AS VARCHAR), 2, '0') END) || (CASE WHEN dd IS NULL THEN '' ELSE '-' || lpad(CAST(dd AS VARCHAR), 2, '0') END) AS iso,
  (CASE WHEN dd IS NULL THEN '' ELSE dd || ' ' END) || (CASE WHEN m IS NULL THEN '' ELSE monthname(o_orderdate) || ' ' END) || y AS long, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS month,
  CAST(CASE WHEN dd IS NOT NULL THEN CAST(o_orderdate AS DATE) + 185 WHEN m IS NULL THEN NULL WHEN date_trunc('month', o_orderdate) < DATE '1999-06-01' THEN last_day(CAST(o_orderdate AS DATE)) + 185
    WHEN date_trunc('month', o_orderdate) = DATE '1999-06-01' THEN DATE '1999-06-15' + 185 ELSE CAST(date_trunc('month', o_orderdate) AS DATE) + 185 END AS VARCHAR) AS expiry FROM d""")
def r70(spark: SparkSession, d: str) -> DataFrame:
    o, m5 = table(spark, d, "orders"), F.col("o_orderkey") % 5
    y, m, dd = F.year("o_orderdate"), F.when(m5 != 0, F.month("o_orderdate")), F.when(m5 >= 2, F.day("o_orderdate"))
    today = F.to_date(F.lit("1999-06-15"))
    month = fields.normalize_month(F.substring(F.lower(F.date_format("o_orderdate", "MMMM")), 1, 3))
    return o.select("o_orderkey", fields.format_date_iso(y, m, dd).alias("iso"), fields.format_date(y, m, dd).alias("long"), month.alias("month"), fields.expiry_date(y, m, dd, today).cast("string").alias("expiry"))


@query("r71_date_findings", """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'invalid' ELSE 'not today' END AS code FROM orders WHERE o_orderkey % 50 = 0 OR abs(date_diff('day', DATE '1999-06-15', CAST(o_orderdate AS DATE))) > 3""")
def r71(spark: SparkSession, d: str) -> DataFrame:
    at, odd = F.col("o_orderdate"), F.col("o_orderkey") % 50 == 0
    part = lambda f, bad: F.when(odd, bad).otherwise(f(at).cast("string"))
    found = fields.date_findings(part(F.year, "1999"), part(F.month, "2"), part(F.dayofmonth, "30"), F.to_date(F.lit("1999-06-15")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(found).alias("f")).select("o_orderkey", "f.code")


@query("r71_partial_dates", """
WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders),
q AS (SELECT o_orderkey, k, y, CASE k WHEN 0 THEN TRY_CAST(y || '-06-15' AS DATE) WHEN 3 THEN NULL ELSE TRY_CAST(y || '-' || lpad(CAST(CASE WHEN k = 2 AND m = 5 THEN 3 WHEN k = 2 AND m = 7 THEN 6 ELSE m END AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) END AS dt FROM p)
SELECT o_orderkey, 'error' AS severity, 'short month' AS code FROM q WHERE k = 2
UNION ALL SELECT o_orderkey, 'warning', 'no month' FROM q WHERE k = 0 AND y <> '1999'
UNION ALL SELECT o_orderkey, 'error', 'invalid' FROM q WHERE dt IS NULL
UNION ALL SELECT o_orderkey, 'warning', 'not today' FROM q WHERE abs(date_diff('day', DATE '1999-06-15', dt)) > 3""")
def r71b(spark: SparkSession, d: str) -> DataFrame:
    """Dates without a month, with its name, with two letters of it, and with a thirteenth month."""
    k, name = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "MMMM")
    month = F.when(k == 1, name).when(k == 2, F.substring(name, 1, 2)).when(k == 3, "13").when(k == 4, F.month("o_orderdate").cast("string"))
    found = fields.date_findings(F.year("o_orderdate").cast("string"), month, F.dayofmonth("o_orderdate").cast("string"), F.to_date(F.lit("1999-06-15")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(found).alias("f")).select("o_orderkey", "f.severity", "f.code")


@query("r73_docname_findings", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'dot' WHEN 1 THEN 'no revision' WHEN 2 THEN 'differs' END AS problem, replace(c_name, '#', '-') || (CASE c_custkey % 4 WHEN 0 THEN '.txt' ELSE '' END) AS base FROM customer""")
def r73(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 4
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("-")), F.when(m == 0, ".txt").when(m == 1, "").otherwise("-03"))
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), F.when(m == 2, F.lit("other")).otherwise(name).alias("series"))
    return rows.select("c_custkey", fields.docname_problem(F.col("name"), F.col("series")).alias("problem"), fields.without_revision(F.col("name")).alias("base"))


@query("r82_format_reference", """
SELECT p_partkey, '[' || p_brand || '] ' || p_type || ', "' || p_name || '", RFC ' || p_size || ', <https://example.org/' || p_partkey || '>.' AS ref FROM part""")
def r82(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fields.format_reference(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.concat(F.lit("RFC "), "p_size"), F.lit(None).cast("string"), F.concat(F.lit("https://example.org/"), "p_partkey")).alias("ref"))


@query("r83_render_xref", """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'see' END AS c, CASE WHEN l_partkey % 7 = 0 AND l_suppkey % 5 = 4 THEN '' ELSE 'P' || l_partkey END AS r, ['of', 'comma', 'parens', 'bare', 'none'][CAST(l_suppkey % 5 + 1 AS INTEGER)] AS f, CASE WHEN l_quantity > 25 THEN '2.1' ELSE 'B' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE f WHEN 'of' THEN l || ' of ' || d || '[' || r || ']' WHEN 'comma' THEN d || '[' || r || '], ' || l WHEN 'parens' THEN d || '[' || r || '] (' || l || ')' WHEN 'bare' THEN s || (CASE WHEN c = '' THEN '' ELSE ' (' || c || ')' END) ELSE CASE WHEN r = '' THEN c ELSE d || '[' || r || ']' END END AS xref
FROM (SELECT *, CASE WHEN c = '' THEN '' ELSE c || ' ' END AS d, CASE WHEN s = 'B' THEN 'Appendix B' ELSE 'Section 2.1' END AS l FROM x)""")
def r83(spark: SparkSession, d: str) -> DataFrame:
    form = F.get(F.array(*map(F.lit, ("of", "comma", "parens", "bare", "none"))), (F.col("l_suppkey") % 5).cast("int"))
    section = F.when(form != "none", F.when(F.col("l_quantity") > 25, "2.1").otherwise("B"))
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", fields.render_xref(F.when(F.col("l_partkey") % 3 == 0, "").otherwise("see"), F.when((F.col("l_partkey") % 7 == 0) & (form == "none"), "").otherwise(F.concat(F.lit("P"), "l_partkey")), F.lit(True), F.lit("default"), section, form).alias("xref"))


@query("r84_cells_from_flat", """
SELECT l_orderkey, l_linenumber, (n - 1) // 3 AS row, (n - 1) % 3 AS col, ['left', 'center', 'right'][CAST((n - 1) % 3 + 1 AS INTEGER)] AS align FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""")
def r84(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumns({"at": F.struct("l_linenumber", "l_partkey", "l_suppkey"), "aligns": F.array(F.lit("left"), F.lit("center"), F.lit("right"))})
    return V.cells_from_flat(l, table="l_orderkey", pos="at", n_cols=F.lit(3), aligns="aligns").select("l_orderkey", "l_linenumber", F.col("row").cast("long"), F.col("col").cast("long"), "align")


@query("r85_place_cells", """
WITH RECURSIVE c AS (SELECT l_orderkey // 40 AS tab, CAST(l_orderkey % 40 AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos, 1 + l_suppkey % 3 AS w, 1 + l_partkey % 2 AS h FROM lineitem),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY row, pos) AS k FROM c),
s AS (
  SELECT tab, CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS row, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS BIGINT) AS col, CAST([] AS BIGINT[]) AS taken FROM o WHERE k = 1
  UNION ALL SELECT tab, k, row, pos, col, list_concat(kept, list_transform(range(0, w * h), lambda i: (row + i // w) * 10000 + col + i % w)) FROM (
    SELECT o.*, list_filter(taken, lambda x: x // 10000 >= o.row) AS kept, list_filter(range(0, len(taken) + 1), lambda x: NOT list_contains(taken, o.row * 10000 + x))[1] AS col FROM s JOIN o ON o.tab = s.tab AND o.k = s.k + 1))
SELECT tab, row, pos, CAST(col AS INTEGER) AS col FROM s WHERE k > 0""")
def r85(spark: SparkSession, d: str) -> DataFrame:
    """Tables of 40 orders, one a row; every item is a cell, in order of its line."""
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    spans = {"colspan": 1 + F.col("l_suppkey") % 3, "rowspan": 1 + F.col("l_partkey") % 2}
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 40).alias("tab"), (F.col("l_orderkey") % 40).alias("row"), nth.alias("pos"), *[c.alias(k) for k, c in spans.items()])
    return place_cells(rows, table="tab", row="row", pos="pos")


FETCHES = """
WITH RECURSIVE f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id UNION ALL SELECT f.user_id, min(e.ts) FROM f JOIN events e ON e.user_id = f.user_id AND e.ts > f.t + INTERVAL 1 DAY GROUP BY f.user_id)
SELECT CAST(e.user_id AS VARCHAR) AS key, e.ts, f.t IS NOT NULL AND row_number() OVER (PARTITION BY e.user_id, e.ts) = 1 AS fetched FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.t = e.ts"""


@query("r91_fresh_fetches", FETCHES)
def r91(spark: SparkSession, d: str) -> DataFrame:
    return fresh_fetches_batch(table(spark, d, "events"), key="user_id", ts="ts", ttl_days=1)


@query("r91_fetch_stream", FETCHES)
def r91b(spark: SparkSession, d: str) -> DataFrame:
    """The requests arrive in two halves by time: the second run of the stream goes on from the checkpoint of the first."""
    base, rows = f"{shared_folder(spark)}/fetches-{uuid.uuid4().hex}", table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    half = rows.agg(F.percentile_approx("ts", F.lit(0.5)).alias("t")).first()["t"]
    for part in (F.col("ts") <= half, F.col("ts") > half):
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        fetch_job(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema=rows.schema, key="user_id", ts="ts", ttl_days=1).awaitTermination()
    return spark.read.schema("key string, ts timestamp, fetched boolean").parquet(f"{base}/out")
