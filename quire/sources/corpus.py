"""Reading corpora and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.markup import Asked, element_batches

REFERENCE_SCHEMA = (
    "_anchor string, _target string, front struct<title string, "
    "author array<struct<_initials string, _surname string, _fullname string, _role string, organization string>>, "
    "date struct<_year string, _month string, _day string>>, seriesInfo array<struct<_name string, _value string>>, broken string"
)
ELEMENT_COLUMNS = ["doc_id", "node_id", "parent_id", "anc_ids", "last_desc", "depth", "sib_pos", "kind", "tag", "attrs", "text", "tail", "anc_tags"]


def read_corpus(spark: SparkSession, path: str, *, fmt: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``xml``: whole files (the id is the file's name without its ending) or two columns of a Parquet table."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("xml"))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("xml"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``anchor``, ``target``, ``title``, ``authors``, ``date``, ``series`` of each ``<reference>`` in the files.

    Files are cut at the ends of references, whatever stands around them, and Spark's XML functions read each: one that can't be read
    has nothing but its text in ``broken``, which is null for all others, and spoils no other of its file.
    """
    parts = spark.read.option("lineSep", "</reference>").text(path)
    one = F.concat(F.regexp_extract("value", r"(?s)<reference(?=[\s/>]).*", 0), F.lit("</reference>"))
    parts = parts.select(one.alias("xml")).filter("xml <> '</reference>'")
    rows = parts.select(F.from_xml("xml", REFERENCE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r")).select("r.*")
    authors = F.transform("front.author", lambda a: F.struct(a["_initials"].alias("initials"), a["_surname"].alias("surname"), a["_fullname"].alias("fullname"), a["_role"].alias("role"), F.trim(a["organization"]).alias("organization")))
    series = F.transform("seriesInfo", lambda s: F.struct(s["_name"].alias("name"), s["_value"].alias("value")))
    date = F.struct(F.expr("try_cast(front.date._year AS int)").alias("year"), F.col("front.date._month").alias("month"), F.expr("try_cast(front.date._day AS int)").alias("day"))
    return rows.select(F.col("_anchor").alias("anchor"), F.col("_target").alias("target"), F.trim("front.title").alias("title"), authors.alias("authors"), date.alias("date"), series.alias("series"), "broken")


def reference_findings(refs: DataFrame) -> DataFrame:
    """``severity``, ``code``, ``message`` of references that can't be read (an error) or have no anchor (a warning)."""
    named = F.when(F.col("broken").isNotNull(), F.struct(F.lit("error").alias("severity"), F.lit("broken-reference").alias("code"), F.regexp_extract("broken", 'anchor="([^"]*)"', 1).alias("message")))
    named = named.when(F.coalesce("anchor", F.lit("")) == "", F.struct(F.lit("warning").alias("severity"), F.lit("no-anchor").alias("code"), F.coalesce("title", F.lit("")).alias("message")))
    return refs.select(named.alias("f")).filter("f IS NOT NULL").select("f.*")


def explode_elements(docs: DataFrame, *, id_col: str = "doc_id", xml_col: str = "xml", asked: Asked | None = None) -> DataFrame:
    """The table of elements: one row for each element, comment and processing instruction; a row of kind ``error`` for bad XML.

    ``anc_ids`` and ``anc_tags`` are a node's ancestors from the root down. Rows leave in batches of some thousands, whole documents each;
    with ``asked``, only the elements and columns that it names.
    """
    src = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(xml_col).alias("xml"))
    what = asked or Asked(tuple(ELEMENT_COLUMNS))
    return src.mapInArrow(lambda parts: element_batches(parts, what), what.schema())


#: Fixed patterns of flat markup: what is dropped first, and one token (a tag and the text after it).
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TOKEN = r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>([^<]*)"


def tokenize_markup(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id``, ``pos``, ``is_close``, ``tag``, ``attrs_raw``, ``text`` of tags in pages that need not be well-formed."""
    clean = F.regexp_replace(html_col, DROPPED, "")
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))).alias("pos", "t"))
    part = lambda i: F.regexp_extract("t", TOKEN, i)
    return rows.select("page_id", "pos", (part(1) == "/").alias("is_close"), F.lower(part(2)).alias("tag"), F.trim(part(3)).alias("attrs_raw"), part(4).alias("text"))


def write_outputs(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """Writes Parquet, JSON, text (one string column) or XML (``rowTag`` and ``rootTag`` as options), by partitions if asked."""
    df.write.format(fmt).options(**options).partitionBy(*partition_by).mode("overwrite").save(path)


def anchor_info_json(sections: DataFrame, *, doc_col: str = "doc_id", anchor_col: str = "anchor", number_col: str = "pn") -> DataFrame:
    """``doc_id``, ``json``: each document's anchors to section numbers, without "section-" before them; anchors that start with "anchor-" are left out."""
    rows = sections.filter(F.col(anchor_col).isNotNull() & ~F.col(anchor_col).startswith("anchor-"))
    one = rows.groupBy(F.col(doc_col).alias("doc_id"), F.col(anchor_col).alias("a")).agg(F.min(F.regexp_replace(number_col, "^section-", "")).alias("n"))
    return one.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "n"))))).alias("json"))
