"""Operators over web pages taken apart into tokens, each with the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fields, text
from quire.jobs.folders import shared_folder
from quire.jobs.lint import Relations, Rule, lint_elements, run_rules, without_errors
from quire.jobs.registry import query, table
from quire.jobs.vocab import BLOCKS, DEPRECATED, KNOWN
from quire.operators import aggregates as A
from quire.operators import elements as E
from quire.operators import windows as V
from quire.sources.corpus import anchor_info_json, tokenize_markup, write_outputs
from quire.streaming.jobs import stream_lint

TOKENS = r"""
c AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>([^<]*)', 0) AS l FROM pages),
x AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM c),
tokens AS (SELECT page_id, pos, starts_with(t, '</') AS is_close, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag,
  trim(regexp_extract(t, '^</?[A-Za-z][A-Za-z0-9]*([^>]*)>', 1)) AS attrs_raw, regexp_extract(t, '>([^<]*)$', 1) AS text FROM x)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenize_markup(table(spark, d, "pages"))


def hrefs(spark: SparkSession, d: str) -> DataFrame:
    """``page_id``, ``pos``, ``href`` of links."""
    t = tokens(spark, d).filter("tag = 'a' AND NOT is_close")
    return t.select("page_id", "pos", fields.parse_pi(F.col("attrs_raw"))["href"].alias("href")).filter("href IS NOT NULL")


HREFS = TOKENS + r""", hrefs AS (SELECT page_id, pos, regexp_extract(attrs_raw, 'href=["'']([^"'']*)["'']', 1) AS href FROM tokens WHERE tag = 'a' AND NOT is_close AND contains(attrs_raw, 'href='))"""


@query("r04_tokenize_markup", f"WITH {TOKENS} SELECT page_id, CAST(pos AS BIGINT) AS pos, is_close, tag, attrs_raw, text FROM tokens")
def r04(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query("r05_write_outputs", f"WITH {TOKENS} SELECT tag, count(*) AS n FROM tokens GROUP BY tag")
def r05(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    write_outputs(tokens(spark, d), path, partition_by=("tag",))
    return spark.read.option("recursiveFileLookup", "false").parquet(path).groupBy(F.col("tag").cast("string").alias("tag")).agg(F.count("*").alias("n"))


@query("r06_anchor_info_json", f"""
WITH {TOKENS}, h AS (SELECT page_id, lower(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS a, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM tokens WHERE tag IN ('title', 'h1', 'p') AND NOT is_close),
g AS (SELECT page_id, a, min(CAST(n AS VARCHAR)) AS n FROM h WHERE a <> '' GROUP BY 1, 2)
SELECT CAST(page_id AS BIGINT) AS doc_id, '{{' || string_agg('"' || a || '":"' || n || '"', ',' ORDER BY a) || '}}' AS json FROM g GROUP BY page_id""")
def r06(spark: SparkSession, d: str) -> DataFrame:
    t = V.flat_numbers(tokens(spark, d).filter("tag IN ('title', 'h1', 'p') AND NOT is_close").withColumn("kind", F.lit("section")), doc="page_id", kind="kind", pos="pos")
    name = F.lower(F.regexp_replace("text", "[^A-Za-z]+", ""))
    anchor = F.when(name != "", name).otherwise("anchor-1")
    return anchor_info_json(t.withColumn("anchor", anchor), doc_col="page_id")


@query("r07_select_elements", f"WITH {TOKENS} SELECT page_id, CAST(pos AS BIGINT) AS pos, text FROM tokens WHERE tag IN ('a', 'meta') AND contains(attrs_raw, 'href=')")
def r07(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).withColumn("attrs", fields.parse_pi(F.col("attrs_raw")))
    return E.select_elements(t, tag=["a", "meta"], has_attr="href").select("page_id", F.col("pos").cast("long").alias("pos"), "text")


@query("r08_remove_subtrees", f"""
WITH {TOKENS}, d AS (SELECT *, sum(CASE WHEN tag NOT IN ('nav', 'footer') THEN 0 WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM tokens)
SELECT page_id, CAST(pos AS BIGINT) AS pos, tag, text FROM d WHERE depth <= 0 AND tag NOT IN ('nav', 'footer')""")
def r08(spark: SparkSession, d: str) -> DataFrame:
    return E.remove_marked(tokens(spark, d), ["nav", "footer"]).select("page_id", F.col("pos").cast("long").alias("pos"), "tag", "text")


@query("r15_rename_tags", f"""
WITH {TOKENS} SELECT CASE WHEN tag = 'b' THEN 'strong' WHEN tag = 'div' AND contains(attrs_raw, 'class="ad"') THEN 'aside' WHEN tag = 'div' THEN 'section' ELSE tag END AS tag, is_close, count(*) AS n FROM tokens GROUP BY 1, 2""")
def r15(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("b", None, "strong"), ("div", "ad", "aside"), ("div", None, "section")], "tag string, style string, new_tag string")
    return E.rename_tags(tokens(spark, d), m, style=fields.parse_pi(F.col("attrs_raw"))["class"]).groupBy("tag", "is_close").agg(F.count("*").alias("n"))


def names(spark: SparkSession, tags: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tags], "tag string")


def sql_list(tags: tuple[str, ...]) -> str:
    return ", ".join(f"'{t}'" for t in tags)


@query("r16_vocabulary_findings", f"""
WITH {TOKENS} SELECT page_id, CAST(pos AS BIGINT) AS pos, tag, 'error' AS severity, 'unknown-tag' AS code FROM tokens WHERE tag NOT IN ({sql_list(KNOWN)})
UNION ALL SELECT page_id, pos, tag, 'warning', 'deprecated-tag' FROM tokens WHERE tag IN ({sql_list(DEPRECATED)})""")
def r16(spark: SparkSession, d: str) -> DataFrame:
    f = E.vocabulary_findings(tokens(spark, d), names(spark, KNOWN), names(spark, DEPRECATED))
    return f.select("page_id", F.col("pos").cast("long").alias("pos"), "tag", "severity", "code")


@query("r18_reserved_prefixes", rf"WITH {HREFS}, i AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos % 3 = 0 THEN 'figure-' ELSE '' END || substr(href, 2) AS anchor FROM hrefs) SELECT * FROM i WHERE regexp_matches(anchor, '^(section|figure|table|iref|u)-')")
def r18(spark: SparkSession, d: str) -> DataFrame:
    i = hrefs(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("pos") % 3 == 0, "figure-").otherwise(""), F.substr("href", F.lit(2))).alias("anchor"))
    return E.reserved_prefix_findings(i)


@query("r32_duplicate_ids", f"WITH {HREFS}, n AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, href, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS nth FROM hrefs) SELECT * FROM n WHERE nth > 1")
def r32(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_ids(hrefs(spark, d).withColumn("pos", F.col("pos").cast("long")), by=["page_id", "href"], order=["pos"])


@query("r39_inner_text", f"WITH {TOKENS} SELECT page_id, string_agg(text, '' ORDER BY pos) AS text FROM tokens GROUP BY page_id")
def r39(spark: SparkSession, d: str) -> DataFrame:
    return A.inner_text(tokens(spark, d), by=["page_id"], pos="pos", text="text")


@query("r40_document_summary", rf"""
WITH {TOKENS} SELECT page_id, arg_min(text, pos) FILTER (WHERE tag = 'title' AND NOT is_close) AS title, arg_min(text, pos) FILTER (WHERE tag = 'h1' AND NOT is_close) AS heading,
  arg_min(regexp_extract(attrs_raw, 'lang="([^"]*)"', 1), pos) FILTER (WHERE tag = 'html' AND NOT is_close) AS lang FROM tokens GROUP BY page_id""")
def r40(spark: SparkSession, d: str) -> DataFrame:
    of = lambda tag, c: F.when((F.col("tag") == tag) & ~F.col("is_close"), c)
    return A.document_summary(tokens(spark, d), doc="page_id", pos="pos", fields={"title": of("title", F.col("text")), "heading": of("h1", F.col("text")), "lang": of("html", fields.parse_pi(F.col("attrs_raw"))["lang"])})


@query("r41_selector_coverage", f"""
WITH {TOKENS}, r AS (SELECT unnest([{sql_list(KNOWN)}]) AS tag) SELECT r.tag, count(t.tag) AS n FROM r LEFT JOIN (SELECT tag FROM tokens WHERE NOT is_close) t ON r.tag = t.tag GROUP BY r.tag""")
def r41(spark: SparkSession, d: str) -> DataFrame:
    return A.selector_coverage(names(spark, KNOWN), tokens(spark, d).filter("NOT is_close"), key="tag")


@query("r44_flat_numbers", f"WITH {TOKENS} SELECT page_id, CAST(pos AS BIGINT) AS pos, tag || '-' || row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) AS pn FROM tokens WHERE NOT is_close AND tag IN ('p', 'a', 'h1')")
def r44(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).filter("NOT is_close AND tag IN ('p', 'a', 'h1')")
    return V.flat_numbers(t, doc="page_id", kind="tag", pos="pos").select("page_id", F.col("pos").cast("long").alias("pos"), "pn")


@query("r45_paragraph_numbers", f"""
WITH {TOKENS} SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE WHEN tag <> 'h1' THEN sum(CASE WHEN tag IN ('p', 'h1', 'ul') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) END AS para FROM tokens WHERE NOT is_close AND tag IN ('p', 'h1', 'ul', 'li')""")
def r45(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).filter("NOT is_close AND tag IN ('p', 'h1', 'ul', 'li')")
    return V.paragraph_numbers(t, by=["page_id"], pos="pos", counts=F.col("tag").isin("p", "h1", "ul"), numbered=F.col("tag") != "h1").select("page_id", F.col("pos").cast("long").alias("pos"), F.col("para").cast("long").alias("para"))


@query("r50_first_child_is", f"""
WITH {TOKENS} SELECT page_id, arg_min(tag = 'p' AND contains(text, 'the'), pos) AS holds FROM tokens WHERE NOT is_close AND tag IN ('h1', 'p', 'b', 'br') AND tag <> 'h1' GROUP BY page_id""")
def r50(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).filter("NOT is_close AND tag IN ('h1', 'p', 'b', 'br')")
    return V.first_child_is(t, by=["page_id"], pos="pos", test=(F.col("tag") == "p") & F.contains("text", F.lit("the")), ignore=F.col("tag") == "h1")


@query("r74_links", r"""
SELECT page_id, CASE WHEN length(url) <= 72 THEN regexp_replace(url, '([/:-])', '\1|', 'g') ELSE url END AS kept,
  regexp_replace(url, '#.*$', '') || (CASE WHEN page_id % 2 = 0 THEN '#section-1.' || page_id ELSE '#appendix-B.' || page_id END) AS section,
  'data:text/plain;base64,' || replace(replace(replace(base64(encode(url)), '+', '%2B'), '=', '%3D'), '%2F', '/') AS data FROM pages""")
def r74(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    section = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("1."), "page_id")).otherwise(F.concat(F.lit("b."), "page_id"))
    return p.select("page_id", fields.urlkeep(F.col("url"), mark="|").alias("kept"), fields.section_link(F.col("url"), section).alias("section"), fields.data_url(F.lit("text/plain"), F.col("url"), base64=True).alias("data"))


@query("r74_rewrite_links", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://bib.example/ids/' || 'x' || page_id || '.xml' ELSE 'https://other.example/a/x' || page_id || '.xml' END AS href FROM pages""")
def r74b(spark: SparkSession, d: str) -> DataFrame:
    host = F.when(F.col("page_id") % 3 == 0, "tracker.example").otherwise("other.example")
    url = F.concat(F.lit("https://"), host, F.lit("/a/x"), "page_id", F.lit(".xml"))
    return table(spark, d, "pages").select("page_id", fields.rewrite_links(url, {"tracker.example": "https://bib.example/ids/"}).alias("href"))


@query("r75_src_findings", rf"""
WITH {HREFS}, s AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE pos % 5 WHEN 0 THEN 'ftp:' || href WHEN 1 THEN substr(href, 2) || '/../../up' WHEN 2 THEN substr(href, 2) || ';rm' WHEN 3 THEN href ELSE 'sub/' || substr(href, 2) END AS src FROM hrefs)
SELECT page_id, pos, CASE pos % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'outside' WHEN 2 THEN 'shell' ELSE 'outside' END AS code FROM s WHERE pos % 5 < 4""")
def r75(spark: SparkSession, d: str) -> DataFrame:
    m, h = F.col("pos") % 5, F.substr("href", F.lit(2))
    src = F.when(m == 0, F.concat(F.lit("ftp:"), "href")).when(m == 1, F.concat(h, F.lit("/../../up"))).when(m == 2, F.concat(h, F.lit(";rm"))).when(m == 3, F.col("href")).otherwise(F.concat(F.lit("sub/"), h))
    return hrefs(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), fields.src_problem(src).alias("code")).filter("code IS NOT NULL")


@query("r76_parse_pi", rf"WITH {TOKENS} SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(attrs_raw, '^([^=]*)=', 1) AS k, regexp_extract(attrs_raw, '=\"([^\"]*)\"', 1) AS v FROM tokens WHERE contains(attrs_raw, '=')")
def r76(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), F.explode(fields.parse_pi(F.col("attrs_raw"))).alias("k", "v"))
    return t


@query("r77_sanitize_id", rf"WITH {HREFS} SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_replace(regexp_replace(href, '^[^A-Za-z_]', '_'), '[^-._A-Za-z0-9]', '_', 'g') AS id FROM hrefs")
def r77(spark: SparkSession, d: str) -> DataFrame:
    return hrefs(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), fields.sanitize_id(F.col("href")).alias("id"))


@query("r87_tag_sets", f"""
WITH {TOKENS}, v AS (SELECT DISTINCT tag FROM tokens), b AS (SELECT tag FROM v WHERE tag IN ({sql_list(BLOCKS)})), t AS (SELECT DISTINCT tag FROM tokens WHERE trim(text) <> '' AND NOT is_close)
SELECT 'block' AS set, tag FROM b UNION ALL SELECT 'text', tag FROM t UNION ALL SELECT 'inline', tag FROM (SELECT tag FROM v EXCEPT SELECT tag FROM b) UNION ALL SELECT 'text_block', tag FROM (SELECT tag FROM b INTERSECT SELECT tag FROM t)""")
def r87(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    v = t.select("tag").distinct()
    return V.tag_sets(v, v.filter(F.col("tag").isin(*BLOCKS)), t.filter("trim(text) <> '' AND NOT is_close").select("tag").distinct())


@query("r95_mixed_content", f"""
WITH {TOKENS}, s AS (SELECT *, sum(CASE WHEN tag IN ('nav', 'div', 'article', 'footer') AND NOT is_close THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS sect FROM tokens)
SELECT page_id, sect FROM s GROUP BY page_id, sect HAVING bool_or(tag IN ({sql_list(BLOCKS)})) AND bool_or(tag = 'b' AND trim(text) <> '')""")
def r95(spark: SparkSession, d: str) -> DataFrame:
    opens = (F.col("tag").isin("nav", "div", "article", "footer") & ~F.col("is_close")).cast("int")
    s = tokens(spark, d).withColumn("sect", F.sum(opens).over(W.partitionBy("page_id").orderBy("pos")))
    return A.mixed_content(s, by=["page_id", "sect"], is_block=F.col("tag").isin(*BLOCKS), has_text=(F.col("tag") == "b") & (F.trim("text") != ""))


RULES = f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, 'error' AS severity, 'empty-heading' AS code, 'Heading without text' AS message FROM tokens WHERE tag IN ('h1', 'title') AND NOT is_close AND trim(text) = ''
UNION ALL SELECT page_id, pos, 'warning', 'long-text', 'Text of ' || length(text) || ' characters' FROM tokens WHERE tag = 'p' AND NOT is_close AND length(text) > 400
UNION ALL SELECT page_id, pos, 'note', 'deprecated', 'Old tag ' || tag FROM tokens WHERE tag IN ({sql_list(DEPRECATED)}) AND NOT is_close
UNION ALL SELECT page_id, pos, 'note', 'non-ascii', 'Text beyond ASCII in ' || tag FROM tokens WHERE regexp_matches(text, '[^\\x00-\\x7F]') AND NOT is_close"""


def page_rules() -> list[Rule]:
    opened = ~F.col("is_close")
    return [
        Rule(F.col("tag").isin("h1", "title") & opened, "error", "empty-heading", F.trim("text") == "", F.lit("Heading without text")),
        Rule((F.col("tag") == "p") & opened, "warning", "long-text", F.length("text") > 400, F.concat(F.lit("Text of "), F.length("text"), F.lit(" characters"))),
        Rule(opened, "note", "deprecated", F.col("tag").isin(*DEPRECATED), F.concat(F.lit("Old tag "), "tag")),
        Rule(opened, "note", "non-ascii", ~text.is_ascii(F.col("text")), F.concat(F.lit("Text beyond ASCII in "), "tag")),
    ]


@query("r92_rules", f"WITH {TOKENS} {RULES}")
def r92(spark: SparkSession, d: str) -> DataFrame:
    return run_rules(tokens(spark, d), page_rules(), doc="page_id", node="pos").withColumn("pos", F.col("pos").cast("long"))


#: What the SQL of all checks knows of each token: its link, its name and what it points to.
MARKED = r"""
marked AS (
  SELECT *, CASE WHEN tag = 'a' AND NOT is_close AND contains(attrs_raw, 'href=') THEN regexp_extract(attrs_raw, 'href=["\']([^"\']*)["\']', 1) END AS href,
    CASE WHEN tag = 'html' AND contains(attrs_raw, 'lang=') THEN regexp_extract(attrs_raw, 'lang="([^"]*)"', 1) END AS lang FROM tokens),
told AS (
  SELECT *, tag = 'a' AS refers, nullif(CASE WHEN href IS NOT NULL THEN regexp_extract(href, '^/([A-Za-z]+)', 1) WHEN tag = 'p' AND NOT is_close THEN regexp_extract(text, '^([A-Za-z]+)', 1) END, '') AS name,
    CASE pos % 3 WHEN 1 THEN text WHEN 2 THEN 'Ω' || text END AS spelt, CASE WHEN pos % 3 < 2 THEN substr(href, 2) END AS twin,
    TRY_CAST(printf('2024-%02d-%02d', length(text) % 14, length(text) % 31) AS DATE) AS dated FROM marked)""".replace("\\'", "''")

ALL = f"""
{MARKED},
f AS ({RULES}
UNION ALL SELECT page_id, pos, 'error', 'unknown-tag', 'Unknown tag ' || tag FROM tokens WHERE tag NOT IN ({sql_list(KNOWN)})
UNION ALL SELECT page_id, pos, 'warning', 'duplicate-link', 'Link to ' || href || ' again' FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS nth FROM hrefs) WHERE nth > 1
UNION ALL SELECT page_id, pos, CASE WHEN length(href) > 10 THEN 'error' ELSE 'warning' END, 'src', 'Link ' || href || ' is outside' FROM hrefs WHERE starts_with(href, '/')
UNION ALL SELECT page_id, sect, 'warning', 'mixed-content', 'Blocks and text in one section' FROM (SELECT *, coalesce(max(CASE WHEN tag IN ('nav', 'div', 'article', 'footer') AND NOT is_close THEN pos END) OVER (PARTITION BY page_id ORDER BY pos), 0) AS sect FROM tokens)
  GROUP BY page_id, sect HAVING bool_or(tag IN ({sql_list(BLOCKS)})) AND bool_or(tag = 'b' AND trim(text) <> '')
UNION ALL SELECT page_id, pos, 'note', 'typed-attr', 'lang is no number: ' || lang FROM told WHERE NOT regexp_matches(lang, '^[0-9]+$') AND lang <> 'en'
UNION ALL SELECT page_id, pos, 'warning', 'reserved-prefix', 'Reserved: ' || name FROM told WHERE name IS NOT NULL AND (pos % 7 = 0 OR regexp_matches(name, '^(section|figure|table|iref|u)-'))
UNION ALL SELECT page_id, pos, 'warning', 'unresolved', 'Nothing is named ' || name FROM told t WHERE refers AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM told o WHERE o.page_id = t.page_id AND o.name = t.name AND NOT o.refers)
UNION ALL SELECT page_id, pos, 'note', 'unused', 'Nothing refers to ' || name FROM told t WHERE NOT refers AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM told o WHERE o.page_id = t.page_id AND o.name = t.name AND o.refers)
UNION ALL SELECT page_id, min(pos), 'warning', 'inconsistent', 'Values that must agree differ' FROM tokens WHERE tag IN ('title', 'h1') AND NOT is_close GROUP BY page_id HAVING count(DISTINCT text) > 1
UNION ALL SELECT page_id, pos, 'note', 'unnumbered-order', 'Numbered after one without a number' FROM (
  SELECT *, max(CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM tokens WHERE tag = 'p' AND NOT is_close) WHERE late = 1 AND length(text) % 5 <> 0
UNION ALL SELECT page_id, pos, 'note', 'date', 'Date is ' || CASE WHEN dated IS NULL THEN 'invalid' ELSE 'not today' END FROM told WHERE tag = 'h1' AND NOT is_close AND (dated IS NULL OR abs(date_diff('day', DATE '2024-06-15', dated)) > 3)
UNION ALL SELECT page_id, pos, 'note', 'docname', substr(href, 2) || ': ' || CASE WHEN contains(substr(href, 2), '.') THEN 'dot' ELSE 'no revision' END FROM told WHERE contains(substr(href, 2), '.') OR NOT regexp_matches(substr(href, 2), '-[0-9]{{2}}$')
UNION ALL SELECT page_id, pos, 'note', 'pair', CASE WHEN spelt = twin THEN 'redundant' WHEN spelt IS NULL THEN 'orphan' ELSE 'missing' END FROM told WHERE href IS NOT NULL AND (spelt = twin OR (spelt IS NULL AND twin IS NOT NULL) OR (twin IS NULL AND spelt IS NOT NULL))),
kept AS (SELECT * FROM f WHERE NOT (starts_with(message, 'Link to /the') OR regexp_matches(message, '^(?:Link to /the)') OR starts_with(message, 'Text of [5-9]..') OR regexp_matches(message, '^(?:Text of [5-9]..)')))"""


def findings(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """All checks of the pages, silenced ones left out. Links outside are errors if they are long, so that pages of both kinds occur.

    Pages stand for documents: links refer to paragraphs by their first word, headings are dates by their length, paragraphs of
    a length that five divides have no number.
    """
    t = tokens(spark, d) if t is None else t
    opened, size, text_col = ~F.col("is_close"), F.length("text"), F.col("text")
    href = F.when((F.col("tag") == "a") & opened, fields.parse_pi(F.col("attrs_raw"))["href"])
    t = t.withColumn("href", href).withColumn("lang", F.when(F.col("tag") == "html", fields.parse_pi(F.col("attrs_raw"))["lang"]))
    first_word = F.when(F.col("href").isNotNull(), F.regexp_extract("href", "^/([A-Za-z]+)", 1)).when((F.col("tag") == "p") & opened, F.regexp_extract("text", "^([A-Za-z]+)", 1))
    t = t.withColumn("name", F.when(first_word != "", first_word))
    third, doc_name = F.col("pos") % 3, F.substr("href", F.lit(2))
    pair = E.pair_problem(F.when(third == 1, text_col).when(third == 2, F.concat(F.lit("Ω"), "text")), F.when(third < 2, doc_name))
    anchor = F.concat(F.when(F.col("pos") % 7 == 0, "figure-").otherwise(""), "name")
    named, outside = fields.docname_problem(doc_name), fields.src_problem(F.col("href")) == "outside"
    rules = [
        *page_rules(),
        Rule(F.lit(True), "error", "unknown-tag", ~F.col("tag").isin(*KNOWN), F.concat(F.lit("Unknown tag "), "tag")),
        Rule(F.length("href") > 10, "error", "src", outside, F.concat(F.lit("Link "), "href", F.lit(" is outside"))),
        Rule(F.length("href") <= 10, "warning", "src", outside, F.concat(F.lit("Link "), "href", F.lit(" is outside"))),
        Rule(F.lit(True), "note", "typed-attr", E.is_no_integer(F.col("lang"), F.lit("en")), F.concat(F.lit("lang is no number: "), "lang")),
        Rule(F.lit(True), "warning", "reserved-prefix", E.is_reserved(anchor), F.concat(F.lit("Reserved: "), "name")),
        Rule(F.lit(True), "note", "docname", named.isNotNull(), F.concat(doc_name, F.lit(": "), named)),
        Rule(F.col("href").isNotNull(), "note", "pair", pair.isNotNull(), pair),
    ]
    dates = fields.date_findings(F.lit("2024"), (size % 14).cast("string"), (size % 31).cast("string"), F.to_date(F.lit("2024-06-15")))
    told = F.transform(dates, lambda x: F.struct(F.lit("note").alias("severity"), F.lit("date").alias("code"), F.concat(F.lit("Date is "), x["code"]).alias("message")))
    relations = Relations(
        link=F.col("href"), name=F.col("name"), refers=F.when(F.col("name").isNotNull(), F.col("tag") == "a"), opens=F.col("tag").isin("nav", "div", "article", "footer") & opened, block=F.col("tag").isin(*BLOCKS),
        text=(F.col("tag") == "b") & (F.trim("text") != ""), agree=F.when(F.col("tag").isin("title", "h1") & opened, text_col), numbered=F.when((F.col("tag") == "p") & opened, size % 5 != 0),
    )
    severities = {"duplicate-link": "warning", "unresolved": "warning", "unused": "note", "inconsistent": "warning", "unnumbered-order": "note"}
    heading = (F.col("tag") == "h1") & opened
    more = [F.when(heading, told).otherwise(F.array().cast("array<struct<severity:string,code:string,message:string>>"))]
    return lint_elements(t, rules, relations, doc="page_id", node="pos", more=more, severities=severities, silence=["Note: Link to /the", "Text of [5-9].."])


@query("lint", f"WITH {HREFS}, {ALL} SELECT severity, code, count(*) AS n, count(DISTINCT page_id) AS pages FROM kept GROUP BY severity, code")
def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every check on every page, counted."""
    return findings(spark, d).groupBy("severity", "code").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("r89_lint_outputs", f"WITH {HREFS}, {ALL} SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM kept WHERE severity = 'error')")
def r89(spark: SparkSession, d: str) -> DataFrame:
    return without_errors(table(spark, d, "pages").select("page_id", "url"), findings(spark, d), doc="page_id")


@query("r90_stream_lint", f"WITH {HREFS}, {ALL} SELECT page_id, CAST(pos AS BIGINT) AS pos, severity, code, message FROM kept")
def r90(spark: SparkSession, d: str) -> DataFrame:
    """The same findings from a stream over the pages' files."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages")
    pages.select("page_id", "html").repartition(4, "page_id").write.parquet(f"{top}/in")
    q = stream_lint(spark, f"{top}/in", f"{top}/out", f"{top}/state", schema="page_id long, html string", check=lambda docs: findings(spark, d, tokenize_markup(docs)))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{top}/out/*").select("page_id", F.col("pos").cast("long").alias("pos"), "severity", "code", "message")
