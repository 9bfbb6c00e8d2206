"""What round 4 found too slow or too large: trees are read by positions, and each result of preparation is one plan without joins or tables."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.jobs.prep import prepare
from quire.operators import windows
from quire.sources import markup
from quire.sources.corpus import ELEMENT_COLUMNS, explode_elements

COLUMNS = (*ELEMENT_COLUMNS, "top_tag")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_xml(r: random.Random, depth: int = 0) -> str:
    if depth > 6 or r.random() < 0.2:
        return r.choice(["", "x", "é", "it's", " \n", "é &amp; y" if r.random() < 0.1 else "z", "<!-- k --> w" if r.random() < 0.1 else "", "a > b" if r.random() < 0.1 else "", "<?set v='1'?>" if r.random() < 0.1 else ""])
    out = ""
    for _ in range(r.randint(0, 4)):
        tag = r.choice(["a", "bb", "c", "section", "cref" if r.random() < 0.1 else "a"])
        attrs = "".join(f' {k}="{r.choice(["", "1", "x y", "é", "a=b", "/"])}"' for k in r.sample(["pn", "k", "anchor"], r.randint(0, 2)))
        attrs = attrs.replace('"', "'") if r.random() < 0.02 else attrs + " " if r.random() < 0.02 else attrs
        out += f"<{tag}{attrs}/>" if r.random() < 0.2 else f"<{tag}{attrs}>{some_xml(r, depth + 1)}</{tag}>" + r.choice(["", "t", "", "ü"])
    return out


PATHS = (("one", markup.Path(("a", "bb"), ("a",))), ("two", markup.Path(("a", "c"), None, ("bb",))))


@pytest.mark.parametrize("size", [150, 5000, 1 << 20])
@pytest.mark.parametrize("asked", [
    markup.Asked(COLUMNS, paths=PATHS, top=("bb", "section"), top_values=(("up", "pn"),), values=(("k", "k"), ("n", "none"))),
    markup.Asked(COLUMNS, dropped=("cref",), paths=PATHS, top=("bb",), top_values=(("up", "pn"), ("k", "k")), firsts=(("first", "c"),), under=(("in", ("bb", "c")),), within=(("w", ("a", "k", "1")),), holds=(("h", ("c", "pn", "x y")),)),
    markup.Asked(("doc_id", "node_id", "text"), tags=("c",), attrs=("anchor",), ascii_but=("a",), dropped=("cref",)),
])
def test_positions_give_what_handlers_give(monkeypatch, asked, size):
    monkeypatch.setattr(markup, "SLICE", size)
    r = random.Random(4)
    docs = [f"<r>{some_xml(r)}</r>" + r.choice(["", " ", "\n"]) if r.random() < 0.95 else r.choice([None, "", "<r><a></r>", "x", "<a", "<a/><b/>"]) for _ in range(400)]
    ids = [None, *map(str, range(399))]
    rows = lambda batches: sorted(tuple(map(repr, x.values())) for b in batches for x in b.to_pylist())
    plain = [x for x in docs if x and isinstance(markup.plain_elements(pa.array(["d"]), pa.array([x])), markup.Elements)]
    assert 100 < len(plain) < 400
    handled = markup.Handled(asked.dropped)
    for i, x in zip(ids, docs, strict=True):
        handled.add(i, x)
    src = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(docs)], ["doc_id", "xml"])
    assert rows(markup.element_batches([src], asked)) == rows([markup.batch_of(handled.elements(), asked)])
    assert rows(markup.element_batches([src.slice(9)], asked)) == rows(markup.element_batches([src.slice(9, 50), src.slice(59)], asked))


def test_deep_trees():
    xml = "<a>" * 3000 + "</a>" * 3000
    got = list(markup.element_batches([pa.RecordBatch.from_arrays([pa.array(["d"]), pa.array([xml])], ["doc_id", "xml"])], markup.Asked(("depth", "last_desc"))))
    assert [r for b in got for r in b["depth"].to_pylist()] == list(range(3000)) and set(got[0]["last_desc"].to_pylist()) == {2999}


MORE = """<rfc><middle><section anchor="a" toc="exclude"><name>A<!-- x --> b</name><t>one<cref>gone <xref target="lost"/></cref></t><section><section toc="include" title="T"/><section/></section><section><name/><name>not this</name></section></section>
<section pn="own"><name>A b</name><figure/><ul><li><t>x</t><t pn="mine">y</t></li></ul><t><xref target="own" format="counter"/><xref target="name-a-b" format="title"/><xref/><xref target="k" anchor="k">it</xref></t></section></middle>
<back><references><reference anchor="R"><t>none</t></reference><reference anchor="S"/></references><note><t>n</t></note><section anchor="a"><t><xref target="S"/></t><keyword>\xe9</keyword></section></back></rfc>"""


def test_prepared_documents_of_all_sorts(spark):
    p = prepare(spark.createDataFrame([("m", MORE), ("x", "<rfc>")], "doc_id string, xml string"), depth=1)
    assert [tuple(r) for r in p.sections.orderBy("node_id").select("number", "pn", "name", "visible").collect()] == [
        ("1", "section-1", "A b", True), ("1.1", "section-1.1", "", True), ("1.1.1", "section-1.1.1", "T", True), ("1.1.2", "section-1.1.2", "", False),
        ("1.2", "section-1.2", "", False), ("2", "own", "A b", True), ("a", "section-appendix.a", "", True),
    ]
    assert sorted((r.target, r.derived, r.id_kind) for r in p.xrefs.collect()) == [("S", "S", "anchor"), ("k", "it", "anchor"), ("name-a-b", "A b", "slug"), ("own", "2", "pn")]
    assert sorted((r.doc_id, r.code, str(r.message)[:20]) for r in p.findings.collect()) == [("m", "duplicate", "The id a again"), ("m", "non-ascii", "Text of <keyword> is"), ("m", "unresolved", "None"), ("m", "unused", "No reference to R"), ("x", "markup", "no element found: li")]
    el = p.elements
    sec = p.sections.select("doc_id", "node_id", "pn").unionByName(el.filter("tag IN ('note', 'references')").select("doc_id", "node_id", F.lit(None).cast("string").alias("pn")))
    want = {tuple(r) for r in windows.nested_paragraph_numbers(el, sec).collect()}
    assert want and {tuple(r) for r in p.paragraphs.collect()} == want


def test_defaults_hold_everywhere(spark):
    defaults = spark.createDataFrame([("section", {"toc": "exclude", "pn": "p"}), ("t", {"anchor": "z"})], "tag string, defaults map<string,string>")
    p = prepare(spark.createDataFrame([("m", '<rfc><section toc="include"><t/><t><xref target="z"/></t></section><section/></rfc>')], "doc_id string, xml string"), defaults=defaults)
    assert [(r.pn, r.visible) for r in p.sections.orderBy("node_id").collect()] == [("p", True), ("p", False)]
    assert [(r.code, r.message) for r in p.findings.collect()] == [("duplicate", "The id z again")]
    assert sorted(r.pn for r in p.paragraphs.collect()) == ["p-1", "p-2"] and p.xrefs.count() == 1


def corpus(spark):
    return prepare(spark.createDataFrame([("m", MORE)], "doc_id string, xml string"))


def one_deal(df) -> None:
    p = plan_of(df)
    assert "Join" not in p and p.count("MapInArrow") == 1 and len(re.findall("Exchange", p)) == 1


def test_xrefs_are_resolved_in_windows_of_one_shuffle(spark):
    one_deal(corpus(spark).xrefs)


def test_paragraphs_are_numbered_where_they_are_read(spark):
    p = plan_of(corpus(spark).paragraphs)
    assert "Exchange" not in p and "Join" not in p and "Window" not in p


def test_only_what_is_asked_for_leaves_the_parser(spark):
    docs = spark.createDataFrame([("m", MORE)], "doc_id string, xml string")
    got = explode_elements(docs, asked=markup.Asked(("doc_id", "tag"), tags=("section",)))
    assert got.columns == ["doc_id", "tag"] and {r.tag for r in got.collect()} == {"section"}


def test_sections_are_shown_where_they_are_read(spark):
    p = plan_of(corpus(spark).sections)
    assert "Exchange" not in p and "Join" not in p and "Window" not in p


def test_marks_by_place_and_by_windows(spark):
    r = random.Random(7)

    def part(depth: int) -> str:
        if depth > 5:
            return ""
        return "".join(f'<section{r.choice(["", "", " toc=\'include\'", """ toc="exclude" """.rstrip(), """ toc=" include" """.rstrip()])}>{part(depth + 1)}</section>' for _ in range(r.randint(0, 3)))

    docs = spark.createDataFrame([(str(i), f"<rfc>{part(0)}</rfc>") for i in range(60)], "doc_id string, xml string")
    none = spark.createDataFrame([("x", {"y": "z"})], "tag string, defaults map<string,string>")
    rows = lambda p: sorted((x.doc_id, x.node_id, x.number, x.visible) for x in p.sections.collect())
    got = rows(prepare(docs, depth=2))
    assert len(got) > 100 and {x[3] for x in got} == {True, False}
    assert got == rows(prepare(docs, depth=2, defaults=none))
    paths = prepare(docs).elements.filter("tag = 'section'").withColumn("mark", F.when(F.col("attrs")["toc"].isin("include", "exclude"), F.col("attrs")["toc"])).withColumn("path", F.concat(F.slice("anc_ids", 2, 99), F.array("node_id")))
    want = windows.toc_visibility(paths, doc="doc_id", node="node_id", path="path", mark="mark", depth=2)
    assert [(x[0], x[1], x[3]) for x in got] == sorted((x.doc_id, x.node_id, x.visible) for x in want.collect())


def test_contents_are_dealt_once(spark):
    p = plan_of(corpus(spark).toc)
    assert "Join" not in p and p.count("MapInArrow") == 1 and len(re.findall("Exchange", p)) == 1 and p.count("Sort [") == 1


def test_findings_come_from_one_shuffle(spark):
    one_deal(corpus(spark).findings)
