"""Trees of elements, from small documents written for these tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import aggregates, elements, joins
from quire.sources import corpus

XML = """<doc><front><title>One</title></front><middle pn="s"><t anchor="a">Some <b>bold <i>very</i> text</b> here</t><note>gone</note>
<t>More<note>x</note> of it</t><!-- c --><toc><t>list</t></toc></middle></doc>"""


def table(spark, *texts):
    return corpus.explode_elements(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "doc_id string, xml string"))


def test_explode(spark):
    rows = {r.node_id: r for r in table(spark, XML).collect()}
    assert [rows[i].tag for i in range(6)] == ["doc", "front", "title", "middle", "t", "b"]
    assert rows[5].anc_ids == [0, 3, 4] and rows[5].text == "bold " and rows[5].tail == " here" and rows[6].tail == " text"
    assert rows[0].last_desc == len(rows) - 1 and rows[4].last_desc == 6 and rows[4].attrs == {"anchor": "a"}
    assert [r.kind for r in rows.values()].count("comment") == 1


def test_bad_and_empty_xml(spark):
    rows = table(spark, "<a><b></a>", "", "<ok/>").collect()
    assert sorted(r.kind for r in rows) == ["element", "error", "error"]
    assert table(spark).count() == 0


def test_remove_subtrees_keeps_tails(spark):
    el = elements.remove_subtrees(table(spark, XML), F.coalesce(F.col("tag") == "note", F.lit(False)))
    rows = [r for r in el.orderBy("node_id").collect()]
    assert "note" not in [r.tag for r in rows]
    t = [r for r in rows if r.tag == "t"]
    assert t[1].text == "More of it"  # no sibling before it: the parent's text
    assert t[0].tail == "\n"  # the tail of the removed sibling


def test_unprep_drops_derived(spark):
    out = elements.unprep(table(spark, XML)).collect()
    assert not [r for r in out if r.tag == "toc" or "pn" in r.attrs]


def test_subtree_text(spark):
    text = {r.node_id: r.text for r in aggregates.subtree_text(table(spark, XML)).collect()}
    assert text[4] == "Some bold very text here" and text[5] == "bold very text"


def test_select_under_and_nearest(spark):
    el = table(spark, XML)
    mid = el.filter("tag = 'middle'")
    assert elements.select_elements(el, tag=["t"], under=mid).count() == 3
    anchored = el.filter(F.map_contains_key("attrs", "anchor")).select("doc_id", "node_id", "depth", F.col("attrs")["anchor"].alias("near"))
    got = {r.tag: r.near for r in joins.nearest_ancestor(el, anchored, value="near").collect() if r.tag in ("i", "title")}
    assert got == {"i": "a", "title": None}


def test_fill_then_strip_is_the_same(spark):
    el = table(spark, XML)
    defaults = spark.createDataFrame([("t", {"keep": "no", "indent": "3"}), ("b", {"x": "y"})], "tag string, defaults map<string,string>")
    filled = elements.fill_attr_defaults(el, defaults)
    assert filled.filter("tag = 't'").first().attrs.keys() >= {"keep", "indent"}
    back = elements.strip_attr_defaults(filled, defaults)
    assert [r.attrs for r in back.orderBy("node_id").collect()] == [r.attrs for r in el.orderBy("node_id").collect()]


def test_read_references(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<references><reference anchor="A1" target="https://x.example"><front><title> A title </title><author initials="J." surname="Doe"><organization> Org </organization></author><author fullname="Ann Lee"/><date year="2020" month="May"/></front><seriesInfo name="RFC" value="0123"/></reference></references>')
    r = corpus.read_references(spark, str(tmp_path / "r.xml")).first()
    assert (r.anchor, r.title, r.series[0].value, len(r.authors), r.date.year, r.date.day) == ("A1", "A title", "0123", 2, 2020, None)


def test_read_corpus_of_files(spark, tmp_path):
    (tmp_path / "draft-a.xml").write_text("<a/>")
    assert [tuple(r) for r in corpus.read_corpus(spark, str(tmp_path)).collect()] == [("draft-a", "<a/>")]
