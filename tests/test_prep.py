"""A small corpus prepared end to end."""

from __future__ import annotations

from quire.jobs.prep import prepare

ONE = """<rfc><front><title>T</title><keyword>né</keyword></front><middle>
<section anchor="intro"><name>Introduction</name><t>See <xref target="deep"/>, <xref target="R1"/> and <xref target="gone"/>.</t></section>
<section><name>Body</name><section anchor="deep"><name>Deep part</name><t><xref target="name-body" format="title"/></t></section><section toc="exclude"><name>Hidden</name></section></section>
<!-- remark --></middle><back><references><reference anchor="R1"/><reference anchor="R2"/></references><section anchor="intro"><name>More</name><section><name>Even more</name></section></section></back></rfc>"""


def test_prepare(spark):
    p = prepare(spark.createDataFrame([("a", ONE), ("b", "<rfc><oops></rfc>"), ("c", None)], "doc_id string, xml string"))
    assert {r["name"]: r.number for r in p.sections.collect()} == {"Introduction": "1", "Body": "2", "Deep part": "2.1", "Hidden": "2.2", "More": "a", "Even more": "a.1"}
    assert {r.pn for r in p.sections.filter("part = 'back'").collect()} == {"section-appendix.a", "section-appendix.a.1"}
    assert {(r.target, r.derived) for r in p.xrefs.collect()} == {("deep", "Section 2.1"), ("R1", "R1"), ("name-body", "Body")}
    assert [r.line for r in p.toc.orderBy("rank").collect()] == ["1. Introduction", "2. Body", "  2.1. Deep part", "Appendix A. More", "  Appendix A.1. Even more"]
    found = {(r.doc_id, r.code, r.message) for r in p.findings.collect()}
    assert {(d, c) for d, c, _ in found} == {("a", "unresolved"), ("a", "unused"), ("a", "duplicate"), ("a", "non-ascii"), ("b", "markup"), ("c", "markup")}
    assert ("a", "unused", "No reference to R2") in found and ("a", "unresolved", "Nothing has the id gone") in found
    assert p.elements.filter("kind = 'comment'").count() == 0
