"""Queries over whole texts, on documents that the given tables lack."""

from __future__ import annotations

import unicodedata

import pytest

from quire.jobs import registry, text_queries  # noqa: F401


@pytest.fixture
def documents(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_pages_of_a_long_document(spark, documents):
    d = documents([(1, "\n".join(f"line {i}" for i in range(2200))), (2, "x")])
    got = registry.QUERIES["r53_wrapped_pages"](spark, d).orderBy("doc_id", "pos").collect()
    assert [r.pos for r in got if r.doc_id == 1] == [i * 1_000_000 for i in range(2200)]
    pages = [r.page for r in got if r.doc_id == 1]
    assert pages == sorted(pages) and pages[-1] > 40


def test_charref_and_names_of_whole_texts(spark, documents):
    rows = [(1, "plain\n" + "a" * 50 + " é\n€"), (2, ""), (3, "ñ\t😀")]
    d = documents(rows)
    refs = {r.doc_id: r.t for r in registry.QUERIES["r65_charref"](spark, d).collect()}
    assert refs == {i: "".join(c if ord(c) < 128 else f"&#{ord(c)};" for c in t) for i, t in rows}
    names = {r.doc_id: r.names for r in registry.QUERIES["r66_character_names"](spark, d).collect()}
    assert names == {i: ", ".join(unicodedata.name(c, f"U+{ord(c):04x}") for c in t) for i, t in rows}
