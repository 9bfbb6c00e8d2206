"""Trees: conversations written as documents of sections, read as elements and prepared, each with the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.jobs.folders import shared_folder, written
from quire.jobs.prep import prepare
from quire.jobs.registry import query, table
from quire.operators.elements import convert_lists, unprep
from quire.operators.joins import scoped_value
from quire.sources.corpus import explode_elements, read_references, reference_findings


def escaped(c: Column) -> Column:
    """Text as it stands in XML."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def conversation_trees(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id``, ``xml``: a section for each turn, with its role as name, its text and a reference to itself."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    section = lambda x, i: F.concat(F.lit('<section pn="section-'), i + 1, F.lit('" anchor="t'), i, F.lit('"><name>'), escaped(x["role"]), F.lit("</name><t>"), escaped(x["text"]), F.lit('<xref target="t'), i, F.lit('"/></t></section>'))
    body = F.array_join(F.transform("t", section), "")
    xml = F.concat(F.lit("<rfc><front><boilerplate><t>Notice</t></boilerplate></front><middle>"), body, F.lit("</middle></rfc>"))
    return turns.select(F.col("conv_id").cast("string").alias("doc_id"), xml.alias("xml"))


TREES = """
c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
e AS (SELECT doc_id, 0 AS node_id, NULL AS parent_id, 'rfc' AS tag, 4 + 4 * n AS last_desc, '' AS attrs, '' AS text FROM n
UNION ALL SELECT doc_id, 1, 0, 'front', 3, '', '' FROM n
UNION ALL SELECT doc_id, 2, 1, 'boilerplate', 3, '', '' FROM n
UNION ALL SELECT doc_id, 3, 2, 't', 3, '', 'Notice' FROM n
UNION ALL SELECT doc_id, 4, 0, 'middle', 4 + 4 * n, '', '' FROM n
UNION ALL SELECT doc_id, 5 + 4 * i, 4, 'section', 8 + 4 * i, 'anchor=t' || i || ';pn=section-' || (i + 1), '' FROM c
UNION ALL SELECT doc_id, 6 + 4 * i, 5 + 4 * i, 'name', 6 + 4 * i, '', role FROM c
UNION ALL SELECT doc_id, 7 + 4 * i, 5 + 4 * i, 't', 8 + 4 * i, '', text FROM c
UNION ALL SELECT doc_id, 8 + 4 * i, 7 + 4 * i, 'xref', 8 + 4 * i, 'target=t' || i, '' FROM c)"""


def flat(el: DataFrame) -> DataFrame:
    """Elements in columns that SQL has too."""
    attrs = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return el.select("doc_id", F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), "tag", F.col("last_desc").cast("long").alias("last_desc"), attrs.alias("attrs"), F.coalesce("text", F.lit("")).alias("text"))


@query("r03_explode_elements", f"WITH {TREES} SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, tag, CAST(last_desc AS BIGINT) AS last_desc, attrs, text FROM e")
def r03(spark: SparkSession, d: str) -> DataFrame:
    return flat(explode_elements(conversation_trees(spark, d)))


@query("r11_unprep", f"WITH {TREES} SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, tag, CAST(last_desc AS BIGINT) AS last_desc, regexp_replace(attrs, ';pn=.*$', '') AS attrs, text FROM e WHERE node_id NOT IN (2, 3)")
def r11(spark: SparkSession, d: str) -> DataFrame:
    return flat(unprep(explode_elements(conversation_trees(spark, d))))


@query("prepare_sections", f"WITH {TREES} SELECT doc_id, CAST(i + 1 AS VARCHAR) AS number, 'section-' || (i + 1) AS pn, role AS name, TRUE AS visible FROM c")
def prepare_sections(spark: SparkSession, d: str) -> DataFrame:
    return prepare(conversation_trees(spark, d)).sections.select("doc_id", "number", "pn", "name", "visible")


@query("prepare_xrefs", f"WITH {TREES} SELECT doc_id, 't' || i AS target, 'Section ' || (i + 1) AS derived FROM c")
def prepare_xrefs(spark: SparkSession, d: str) -> DataFrame:
    return prepare(conversation_trees(spark, d)).xrefs.select("doc_id", "target", "derived")


def by_customer(orders: DataFrame) -> DataFrame:
    """Orders of a customer together: what is grouped by its document (``doc_id``) then shuffles no more, and tasks that parse their XML aren't merged by its size."""
    return orders.repartition(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def customer_trees(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id``, ``xml``: a document for each customer. Priorities hold orders, orders hold lines; pending orders are appendices.

    Orders have marks for the contents; lines repeat ids, refer to their order, to a line, or to nothing, and hold a list whose
    length differs, some of them a figure.
    """
    key = [F.col(f"l_{c}").alias(c) for c in ("linenumber", "partkey", "suppkey", "quantity")]
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*key))).alias("lines"))
    item = F.lit("<li><t>one</t><t>two</t></li>")

    def line(x: Column, i: Column) -> Column:
        target = F.when(x["suppkey"] % 3 == 0, F.concat(F.lit("o"), "o_orderkey")).when(x["suppkey"] % 3 == 1, F.concat(F.lit("d"), x["partkey"] % 50)).otherwise(F.concat(F.lit("gone"), x["partkey"]))
        form = F.when(x["linenumber"] % 3 == 0, "counter").when(x["linenumber"] % 3 == 1, "title").otherwise("default")
        parts = [
            F.lit('<section anchor="d'), x["partkey"] % 50, F.lit('"><name>Line '), i + 1, F.lit('</name><t><xref target="'), target, F.lit('" format="'), form, F.lit('"/></t><ul>'),
            F.repeat(item, (x["quantity"] % 3).cast("int") + 1), F.lit("</ul>"), F.when(x["partkey"] % 2 == 0, "<figure/>").otherwise(""), F.lit("<t>end</t></section>"),
        ]
        return F.concat(*parts)

    mark = F.when(F.col("o_orderkey") % 5 == 0, ' toc="include"').when(F.col("o_orderkey") % 7 == 0, ' toc="exclude"').otherwise("")
    orders = table(spark, d, "orders").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.array_join(F.transform(F.coalesce("lines", F.array()), line), "")
    xml = F.concat(F.lit('<section anchor="o'), "o_orderkey", F.lit('"'), mark, F.lit("><name>Order "), "o_orderkey", F.lit("</name>"), body, F.lit("</section>"))
    orders = orders.select(F.col("o_custkey").cast("string").alias("doc_id"), (F.col("o_orderstatus") == "P").alias("back"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"), F.struct("o_orderkey", xml.alias("xml")).alias("o"))
    inner = by_customer(orders).groupBy("doc_id", "back", "priority").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["xml"]), "").alias("xml"))
    xml = F.when(F.col("back"), F.col("xml")).otherwise(F.concat(F.lit("<section><name>"), "priority", F.lit("</name>"), "xml", F.lit("</section>")))
    whole = inner.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("back", "priority", xml.alias("xml")))).alias("s"))
    part = lambda back: F.array_join(F.transform(F.filter("s", lambda x: x["back"] == back), lambda x: x["xml"]), "")
    return whole.select("doc_id", F.concat(F.lit("<rfc><front/><middle>"), part(F.lit(False)), F.lit("</middle><back>"), part(F.lit(True)), F.lit("</back></rfc>")).alias("xml"))


DEEP = """
o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS k, o_orderstatus = 'P' AS back, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS pri, CASE WHEN o_orderkey % 5 = 0 THEN 'include' WHEN o_orderkey % 7 = 0 THEN 'exclude' END AS mark FROM orders),
r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, back ORDER BY pri) AS r1, row_number() OVER (PARTITION BY doc_id, back, pri ORDER BY k) AS r2 FROM o),
q AS (SELECT *, CASE WHEN NOT back THEN r1 || '.' || r2 WHEN r2 <= 26 THEN chr(CAST(96 + r2 AS INTEGER)) END AS num FROM r),
l AS (SELECT q.*, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_linenumber AS ln, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r3 FROM q JOIN lineitem ON l_orderkey = k),
s AS (
  SELECT DISTINCT doc_id, false AS back, pri, -1 AS k, 0 AS r3, CAST(r1 AS VARCHAR) AS number, pri AS name, 1 AS depth, true AS visible, NULL AS anchor FROM q WHERE NOT back
  UNION ALL SELECT doc_id, back, pri, k, 0, num, 'Order ' || k, CASE WHEN back THEN 1 ELSE 2 END, coalesce(mark, '') <> 'exclude', 'o' || k FROM q
  UNION ALL SELECT doc_id, back, pri, k, r3, num || '.' || r3, 'Line ' || r3, CASE WHEN back THEN 2 ELSE 3 END, back AND coalesce(mark, '') <> 'exclude', 'd' || (part % 50) FROM l),
sec AS (SELECT *, CASE WHEN back THEN 'section-appendix.' ELSE 'section-' END || number AS pn, row_number() OVER (PARTITION BY doc_id ORDER BY back, pri, k, r3) AS pos FROM s),
named AS (SELECT doc_id, anchor, arg_min(number, pos) AS number, arg_min(name, pos) AS name FROM sec WHERE anchor IS NOT NULL GROUP BY doc_id, anchor),
x AS (SELECT doc_id, CASE supp % 3 WHEN 0 THEN 'o' || k WHEN 1 THEN 'd' || (part % 50) ELSE 'gone' || part END AS target, CASE ln % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'title' ELSE 'default' END AS form FROM l)"""


@query("prepare_deep_sections", f"WITH {DEEP} SELECT doc_id, number, pn, name, visible FROM sec")
def prepare_deep_sections(spark: SparkSession, d: str) -> DataFrame:
    return prepare(customer_trees(spark, d), depth=2).sections.select("doc_id", "number", "pn", "name", "visible")


@query("prepare_deep_contents", f"""
WITH {DEEP} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank, repeat('  ', depth - 1) || CASE WHEN back THEN 'Appendix ' || upper(number) ELSE number END || '. ' || name AS line FROM sec WHERE visible""")
def prepare_deep_contents(spark: SparkSession, d: str) -> DataFrame:
    return prepare(customer_trees(spark, d), depth=2).toc.select("doc_id", F.col("rank").cast("long").alias("rank"), "line")


@query("prepare_deep_xrefs", f"""
WITH {DEEP} SELECT x.doc_id, target, CASE form WHEN 'counter' THEN n.number WHEN 'title' THEN n.name ELSE 'Section ' || n.number END AS derived, count(*) AS n FROM x JOIN named n ON x.doc_id = n.doc_id AND x.target = n.anchor GROUP BY ALL""")
def prepare_deep_xrefs(spark: SparkSession, d: str) -> DataFrame:
    return prepare(customer_trees(spark, d), depth=2).xrefs.groupBy("doc_id", "target", "derived").agg(F.count(F.lit(1)).alias("n"))


@query("prepare_deep_findings", f"""
WITH {DEEP} SELECT doc_id, 'error' AS severity, 'unresolved' AS code, 'Nothing has the id ' || target AS message, count(*) AS n FROM x WHERE starts_with(target, 'gone') GROUP BY ALL
UNION ALL SELECT doc_id, 'error', 'duplicate', 'The id ' || anchor || ' again', count(*) - 1 FROM sec WHERE anchor IS NOT NULL GROUP BY doc_id, anchor HAVING count(*) > 1""")
def prepare_deep_findings(spark: SparkSession, d: str) -> DataFrame:
    return prepare(customer_trees(spark, d), depth=2).findings.groupBy("doc_id", "severity", "code", "message").agg(F.count(F.lit(1)).alias("n"))


@query("r45_nested_paragraphs", f"""
WITH {DEEP}, t AS (SELECT l.*, CASE WHEN back THEN 'section-appendix.' ELSE 'section-' END || num || '.' || r3 AS pn, unnest(range(1, CAST(qty % 3 + 2 AS BIGINT))) AS i FROM l)
SELECT doc_id, 'li' AS tag, pn || '-2.' || i AS pn FROM t UNION ALL SELECT doc_id, 't', pn || '-2.' || i || '.' || j FROM t, (SELECT unnest([1, 2]) AS j)
UNION ALL SELECT doc_id, 't', pn || '-1' FROM t WHERE i = 1 UNION ALL SELECT doc_id, 'ul', pn || '-2' FROM t WHERE i = 1 UNION ALL SELECT doc_id, 't', pn || '-' || (CASE WHEN part % 2 = 0 THEN 4 ELSE 3 END) FROM t WHERE i = 1""")
def r45_nested(spark: SparkSession, d: str) -> DataFrame:
    return prepare(customer_trees(spark, d), depth=2).paragraphs.select("doc_id", "tag", "pn")


@query("r26_scoped_settings", """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, last_value(CASE WHEN o_orderkey % 5 = 0 THEN 'after' || o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM orders),
l AS (SELECT o.*, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey AS part FROM o JOIN lineitem ON l_orderkey = k),
p AS (SELECT *, CASE WHEN part % 4 = 0 THEN 'line' || k || '.' || n END AS pi, CASE WHEN k % 3 = 0 THEN 'order' || k END AS own FROM l)
SELECT CAST(doc AS VARCHAR) AS doc_id, k || '-' || n AS anchor, coalesce(last_value(pi IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), own, earlier) AS value FROM p
UNION ALL SELECT CAST(o.doc AS VARCHAR), CAST(o.k AS VARCHAR), coalesce(CASE WHEN o.k % 3 = 0 THEN 'order' || o.k END, i.pi, o.earlier) FROM o LEFT JOIN (SELECT k, arg_min(pi, n) AS pi FROM p WHERE pi IS NOT NULL GROUP BY k) i ON i.k = o.k""")
def r26_scoped(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer; settings stand after orders, at the start of some, and before some of their lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    orders = table(spark, d, "orders").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    setting = lambda when, *name: F.when(when, F.concat(F.lit('<?set v="'), *name, F.lit('"?>'))).otherwise("")
    line = lambda x, i: F.concat(setting(x["l_partkey"] % 4 == 0, F.lit("line"), key, F.lit("."), i + 1), F.lit('<t anchor="'), key, F.lit("-"), i + 1, F.lit('"/>'))
    inner = F.array_join(F.transform(F.coalesce("lines", F.array()), line), "")
    xml = F.concat(F.lit('<section anchor="'), key, F.lit('">'), setting(key % 3 == 0, F.lit("order"), key), inner, F.lit("</section>"), setting(key % 5 == 0, F.lit("after"), key))
    docs = by_customer(orders.select(F.col("o_custkey").cast("string").alias("doc_id"), F.struct(key, xml.alias("xml")).alias("o"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["xml"]), "").alias("xml"))
    el = written(explode_elements(docs.select("doc_id", F.concat(F.lit("<rfc>"), "xml", F.lit("</rfc>")).alias("xml"))))
    return scoped_value(el, key="v", target="set").filter("attrs['anchor'] IS NOT NULL").select("doc_id", F.col("attrs")["anchor"].alias("anchor"), "value")


def kind_sql(style: str, tag: str, type_: str) -> str:
    """SQL of a list's kind from its style and the kind of the list around it."""
    return f"""CASE {style} WHEN 'letters' THEN {{'tag': 'ol', 'type': 'a', 'empty': false}} WHEN 'numbers' THEN {{'tag': 'ol', 'type': '1', 'empty': false}} WHEN 'format %c.' THEN {{'tag': 'ol', 'type': '%c.', 'empty': false}}
  WHEN 'hanging' THEN {{'tag': 'dl', 'type': NULL, 'empty': false}} WHEN '' THEN {{'tag': coalesce({tag}, 'ul'), 'type': CASE {type_} WHEN 'a' THEN 'A' WHEN 'A' THEN 'a' WHEN 'i' THEN 'I' WHEN 'I' THEN 'i' ELSE {type_} END, 'empty': {tag} IS NULL}}
  ELSE {{'tag': 'ul', 'type': NULL, 'empty': {style} = 'empty'}} END"""


@query("r15_list_styles", f"""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS k, o_orderkey % 4 = 0 AS isol, o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 AS isdl, ['letters', 'numbers', 'symbols', 'hanging', 'format %c.', '', 'odd', 'empty'][CAST(o_custkey % 8 + 1 AS INTEGER)] AS style FROM orders),
a AS (SELECT doc_id, k, isol OR isdl AS old, CASE WHEN isol THEN {{'tag': 'ol', 'type': 'i', 'empty': false}} WHEN isdl THEN {{'tag': 'dl', 'type': NULL, 'empty': false}} ELSE {kind_sql("style", "NULL", "NULL")} END AS one FROM o),
l AS (SELECT a.*, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_partkey % 5 = 0 THEN 'letters' ELSE '' END AS style FROM a JOIN lineitem ON l_orderkey = k),
b AS (SELECT *, {kind_sql("style", "one.tag", "one.type")} AS two FROM l), c AS (SELECT *, {kind_sql("''", "two.tag", "two.type")} AS three FROM b),
r AS (SELECT doc_id, CAST(k AS VARCHAR) AS anchor, one AS x, '' AS g FROM a WHERE NOT old UNION ALL SELECT doc_id, k || '-' || n, two, '' FROM c UNION ALL SELECT doc_id, k || '-' || n || '-in', three, 'group=c;' FROM c)
SELECT doc_id, anchor, x.tag AS tag, CASE WHEN x.empty THEN 'empty=true' WHEN x.tag = 'dl' THEN 'newline=false' WHEN x.tag = 'ol' THEN g || 'type=' || x.type ELSE '' END AS attrs FROM r""")
def r15_styles(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer: a list for each order, in it one for each line, some with a style, and in each of those one without."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    key = F.col("o_orderkey")
    anchor = lambda *parts: F.concat(F.lit(' anchor="'), *parts, F.lit('"'))
    line = lambda x, i: F.concat(F.lit("<t><list"), anchor(key, F.lit("-"), i + 1), F.when(x["l_partkey"] % 5 == 0, ' style=" letters"').otherwise(""), F.lit("><t><list counter=\"c\""), anchor(key, F.lit("-"), i + 1, F.lit("-in")), F.lit("/></t></list></t>"))
    style = F.get(F.array(*map(F.lit, ("letters", "numbers", "symbols", "hanging", "format %c.", "", "odd", "empty"))), (F.col("o_custkey") % 8).cast("int"))
    name = F.when(key % 4 == 0, "ol").when((key % 4 == 1) & (key % 3 == 0), "dl").otherwise("list")
    head = F.when(name == "ol", ' type="i"').when(name == "list", F.concat(F.lit(' style="'), style, F.lit('"'))).otherwise("")
    orders = table(spark, d, "orders").join(lines.hint("merge"), key == F.col("l_orderkey"), "left")
    xml = F.concat(F.lit("<"), name, anchor(key), head, F.lit(">"), F.array_join(F.transform(F.coalesce("lines", F.array()), line), ""), F.lit("</"), name, F.lit(">"))
    docs = by_customer(orders.select(F.col("o_custkey").cast("string").alias("doc_id"), F.struct(key, xml.alias("xml")).alias("o"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["xml"]), "").alias("xml"))
    # written, since lists and those around them are read: XML is parsed once
    el = written(explode_elements(docs.select("doc_id", F.concat(F.lit("<rfc>"), "xml", F.lit("</rfc>")).alias("xml"))))
    lists = el.filter("tag IN ('list', 'ul', 'ol', 'dl')").withColumn("was", F.col("tag"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: k != "anchor")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return convert_lists(lists).filter("was = 'list'").select("doc_id", F.col("attrs")["anchor"].alias("anchor"), "tag", shown.alias("attrs"))


def library(spark: SparkSession, d: str) -> DataFrame:
    """References to parts, read from XML files that are written from ``part``: each twentieth is broken, some have no anchor."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    anchor = F.when(k % 9 == 4, "").otherwise(F.concat(F.lit(' anchor="P'), k, F.lit('"')))
    author = F.concat(F.lit('<author surname="'), "p_brand", F.lit('" initials="A."/>'))
    xml = F.concat(
        F.lit("<reference"), anchor, F.lit("><front><title>"), escaped(F.col("p_name")), F.when(k % 20 == 0, "</titel>").otherwise("</title>"), F.repeat(author, (k % 3).cast("int")),
        F.lit('<date year="'), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit('"/></front><seriesInfo name="RFC" value="0'), k, F.lit('"/></reference>'),
    )
    path = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    p.select(xml.alias("value")).write.text(path)
    return read_references(spark, path)


@query("r02_read_references", """
SELECT CASE WHEN p_partkey % 9 <> 4 THEN 'P' || p_partkey END AS anchor, p_name AS title, CAST(p_partkey % 3 AS INTEGER) AS authors, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS first, CAST(1990 + p_size AS INTEGER) AS year, '0' || p_partkey AS number FROM part WHERE p_partkey % 20 <> 0""")
def r02(spark: SparkSession, d: str) -> DataFrame:
    r = library(spark, d).filter("broken IS NULL")
    return r.select("anchor", "title", F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)).alias("authors"), F.get("authors", F.lit(0))["surname"].alias("first"), F.col("date.year").alias("year"), F.get("series", F.lit(0))["value"].alias("number"))


@query("r02_reference_findings", """
SELECT CASE WHEN p_partkey % 20 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN p_partkey % 20 = 0 THEN 'broken-reference' ELSE 'no-anchor' END AS code,
  CASE WHEN p_partkey % 20 <> 0 THEN p_name WHEN p_partkey % 9 <> 4 THEN 'P' || p_partkey ELSE '' END AS message FROM part WHERE p_partkey % 20 = 0 OR p_partkey % 9 = 4""")
def r02b(spark: SparkSession, d: str) -> DataFrame:
    return reference_findings(library(spark, d))
