"""Cases that the tables don't hold."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.functions import fields, helpers, text


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_tabs_expand_to_stops(spark):
    assert one(spark, text.normalize_code_lines(F.col("c")), c="a\tb  \n\tc\n") == "a       b\n        c\n"


def test_labels(spark):
    got = [one(spark, text.list_label(F.lit(n), s)) for n, s in ((1, "a"), (26, "a"), (27, "a"), (4, "I"), (3999, "i"), (4000, "i"), (255, "x"), (8, "o"))]
    assert got == ["a", "z", "ba", "IV", "mmmcmxcix", None, "ff", "10"]


def test_expiry(spark):
    day = lambda y, m, d, **k: one(spark, fields.expiry_date(F.lit(y), F.lit(m), F.lit(d), F.lit(dt.date(2024, 5, 10)), **k))
    none = F.lit(None).cast("int")
    assert day(2024, 5, 1) == dt.date(2024, 5, 1) + dt.timedelta(185)
    assert one(spark, fields.expiry_date(F.lit(2024), F.lit(2), none, F.lit(dt.date(2024, 5, 10)))) == dt.date(2024, 2, 29) + dt.timedelta(185)
    assert one(spark, fields.expiry_date(F.lit(2024), F.lit(7), none, F.lit(dt.date(2024, 5, 10)))) == dt.date(2024, 7, 1) + dt.timedelta(185)
    assert one(spark, fields.expiry_date(F.lit(2024), F.lit(7), none, F.lit(dt.date(2024, 5, 10)), legacy=True)) is None  # a Monday


def test_months(spark):
    assert [one(spark, fields.normalize_month(F.lit(m))) for m in ("ma", "Sept", "june", "x")] == ["03", "09", "06", "x"]


def test_justify_cuts_the_longest(spark):
    line = one(spark, text.justify_line(F.lit("a" * 60), F.lit("bb"), F.lit("c" * 20)))
    assert line == "a" * 35 + "bb" + "a" * 13 + " " * 2 + "c" * 20


def test_null_in_null_out(spark):
    null = F.lit(None).cast("string")
    for f in (text.clean_text, text.downcode, text.fold_newlines, text.scripts_used, fields.sanitize_id, text.charref, text.normalize_item_text):
        assert one(spark, f(null)) in (None, "")


def test_expand_unicode_needs_num():
    with pytest.raises(ValueError):
        text.expand_unicode(F.lit("x"), "lit-char")


def test_paths(spark):
    got = [one(spark, fields.src_problem(F.lit(p))) for p in ("a/../b", "a/../../b", "x|y", "mailto:x", "https://e.example/|", "/abs")]
    assert got == [None, "outside", "shell", "scheme", None, "outside"]


def test_dates_with_missing_parts(spark):
    today = F.to_date(F.lit("2024-03-10"))
    found = lambda *d, **kw: [r["code"] for r in one(spark, fields.date_findings(*[F.lit(x).cast("string") for x in d], today, **kw))]
    assert found(None, None, None) == [] and found("", " ", "") == []
    assert found("2024", "March", "9") == [] and found("2024", "mar", "20") == ["not today"] and found("2024", "3", "20", published=True) == []
    assert found("2023", None, None) == ["no month", "not today"] and found("2024", "2", "30") == ["invalid"]
    assert found("2024", "ma", "10") == ["short month"] and found("2024", "nonsense", "1") == ["invalid"] and found("2024", "3", None) == ["not today"]


def test_references_with_missing_parts(spark):
    null, lit = F.lit(None).cast("string"), F.lit
    assert one(spark, fields.format_reference(lit("A"), null, lit("T"), null, null, null)) == '[A] "T".'
    assert one(spark, fields.format_reference(lit("A"), lit("B"), lit("T"), lit("S 1"), lit("May 2024"), lit("u"))) == '[A] B, "T", S 1, May 2024, <u>.'
    xref = lambda content, is_ref, fmt, sec, form: one(spark, fields.render_xref(lit(content), lit("R"), lit(is_ref), lit(fmt), lit(sec).cast("string"), lit(form)))
    assert [xref("", True, "default", None, "of"), xref("see", True, "default", None, "of"), xref("see", False, "default", None, "of")] == ["[R]", "see [R]", "see (R)"]
    assert [xref("", True, "default", "2", f) for f in ("of", "comma", "parens", "bare")] == ["Section 2 of [R]", "[R], Section 2", "[R] (Section 2)", "2"]


def test_base64_of_data_is_one_line(spark):
    import base64
    from urllib.parse import unquote

    for text in ("x" * 57, "x" * 58, "http://a.example/?" + "é&" * 200):
        url = one(spark, fields.data_url(F.lit("text/plain"), F.col("t"), base64=True), t=text)
        assert unquote(url) == "data:text/plain;base64," + base64.b64encode(text.encode()).decode()


def test_code_points_of_all_planes(spark):
    t = "a\x00 \uffff\U00010000\U0010ffff中\n"
    want = " ".join(f"U+{ord(x):04X}" for x in t)
    assert one(spark, text.expand_unicode(F.col("t"), "num"), t=t) == want and one(spark, text.expand_unicode(F.col("t"), "num"), t="") == ""
    # one pass over the text, no row or format for each character
    plan = spark.range(1).select(text.expand_unicode(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
