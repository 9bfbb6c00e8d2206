"""Text functions over the given tables, each with the SQL that must agree."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fields, helpers, text
from quire.jobs.registry import query, table
from quire.operators import joins, pages, windows
from quire.operators.elements import silence_findings
from quire.sources import corpus

WS = r"[ \t\n\x0B\f\r]"
#: Puts characters into texts that the tables lack: every seventh word gap, in turn. The SQL does the same.
FIRST_LINE = "split_part(text, chr(10), 1)"


@query("r01_read_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n, sha256(text) AS digest FROM documents")
def r01(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.read_corpus(spark, f"{d}/documents.parquet", fmt="parquet")
    return rows.select("doc_id", F.length("xml").cast("long").alias("n"), F.sha2("xml", 256).alias("digest"))


@query("r33_scripts_used", r"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(s, '\p{Common}') THEN 'Common' END, CASE WHEN regexp_matches(s, '\p{Cyrillic}') THEN 'Cyrillic' END,
  CASE WHEN regexp_matches(s, '\p{Greek}') THEN 'Greek' END, CASE WHEN regexp_matches(s, '\p{Han}') THEN 'Han' END,
  CASE WHEN regexp_matches(s, '\p{Latin}') THEN 'Latin' END], lambda x: x IS NOT NULL), ',') AS scripts
FROM (SELECT doc_id, substr(text, 1, 100) || regexp_replace(substr(text, 101), '[\x00-\x7F]+', '', 'g') AS s FROM documents)""")
def r33(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.scripts_used(F.col("text"), ("Common", "Cyrillic", "Greek", "Han", "Latin")).alias("scripts"))


@query("r58_slugify", r"""
SELECT doc_id, pos,
  trim(regexp_replace(regexp_replace(lower(trim(l)), '[^\p{L}\p{N}_\s/|@=-]', '', 'g'), '[_\s/|@=-]+', '_', 'g'), '_') AS selector,
  trim(regexp_replace(regexp_replace(lower(trim(l)), '[^\p{L}\p{N}_\s/|-]', '', 'g'), '[_\s/|-]+', '-', 'g'), '-') AS html,
  regexp_replace(lower(trim(regexp_replace(regexp_replace(translate(l, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_\s/-]', '', 'g'))), '[-\s/]+', '-', 'g') AS name
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents)""")
def r58(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("line")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), text.slugify(c).alias("selector"), text.slugify(c, "html").alias("html"), text.slugify(c, "name").alias("name"))


@query("r59_normalize_item_text", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.    '), '[ \t\n\r\f\v]', ' ', 'g'), '\.   +', '.  ', 'g'), '([^.])  +', '\1 ', 'g')) AS t FROM documents""")
def r59(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_item_text(F.replace("text", F.lit(". "), F.lit(".    "))).alias("t"))


@query("r60_fold_newlines", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[\s\v]+', ''), '\.[\s\v]*\n[\s\v]*', '.  ', 'g'), '[\s\v]*\n[\s\v]*', ' ', 'g') AS t FROM documents""")
def r60(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.fold_newlines(F.col("text")).alias("t"))


@query("r61_code_lines", r"""
SELECT conv_id, turn, array_to_string(list_transform(string_split(replace(text, ' la ', ' la  ' || chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)) AS code, FALSE AS tabs FROM conversations""")
def r61(spark: SparkSession, d: str) -> DataFrame:
    c = F.replace("text", F.lit(" la "), F.lit(" la  \n"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalize_code_lines(c).alias("code"), text.has_tabs(c).alias("tabs"))


@query("r62_clean_text", r"""
SELECT doc_id, regexp_replace(regexp_replace(translate(t, chr(160) || chr(8232), '  '), '[\x{200B}\x{2060}\x{E060}]', '', 'g'), '^\s+|\s+$', '', 'g') AS t
FROM (SELECT doc_id, replace(replace(text, ' de ', chr(160) || 'de' || chr(8203) || ' '), ' the ', chr(8232) || 'the' || chr(8288) || ' ') AS t FROM documents)""")
def r62(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit(" de "), F.lit("\u00a0de\u200b ")), F.lit(" the "), F.lit("\u2028the\u2060 "))
    return table(spark, d, "documents").select("doc_id", text.clean_text(t).alias("t"))


@query("r63_is_ascii", r"SELECT doc_id, regexp_matches(text, '^[\x00-\x7F\x{A0}\x{200B}\x{2011}\x{2028}\x{2060}]*$') AS ascii FROM documents")
def r63(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.is_ascii(F.col("text")).alias("ascii"))


@query("r64_is_script", r"""
SELECT doc_id, regexp_matches(text, '^[\p{Latin}\p{Common}\p{Inherited}]*$') AS latin, regexp_matches(text, '^[\p{Greek}\p{Common}\p{Inherited}]*$') AS greek FROM documents""")
def r64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.is_script(F.col("text"), "Latin").alias("latin"), text.is_script(F.col("text"), "Greek").alias("greek"))


@query("r65_downcode", r"""
SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(translate(replace(replace(replace(replace(translate(t,
  chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8216) || chr(8217) || chr(8218) || chr(8220) || chr(8221) || chr(8222) || chr(160) || chr(8239), '----' || repeat(chr(39), 3) || repeat(chr(34), 3) || '  '), '—', '--'), '…', '...'), '«', '<<'), '»', '>>'),
  'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'),
  'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe'), 'ß', 'ss'), 'Ø', 'O'), 'ø', 'o'), 'Þ', 'Th'), 'þ', 'th'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g') AS t
FROM (SELECT doc_id, replace(replace(text, '. ', '… “x” — '), ', ', ' – ') AS t FROM documents)""")
def r65(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit(". "), F.lit("… “x” — ")), F.lit(", "), F.lit(" – "))
    return table(spark, d, "documents").select("doc_id", text.downcode(t).alias("t"))


@query("r65_charref", "SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN unicode(c) > 127 THEN '&#' || unicode(c) || ';' ELSE c END), '') AS t FROM documents")
def r65b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.charref(F.coalesce("text", F.lit(""))).alias("t"))


def sql_map(m: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in m.items()) + "}"


@query("r65_full_downcode", f"""
SELECT doc_id, array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 OR c IN (chr(9), chr(10), chr(13)) OR unicode(c) IN (160, 8203, 8209, 8232, 8288, 57440) THEN c WHEN unicode(c) < 128 THEN ' '
  ELSE coalesce(m[c], '&#' || unicode(c) || ';') END), '') AS t
FROM (SELECT doc_id, replace(replace(replace(replace(text, '. ', '… “½” — '), ', ', ' ﬁ™ № '), ' de ', chr(160) || 'Ǣ中🎉' || chr(8203) || chr(7)), ' the ', ' Ωǆ ') AS t FROM documents), (SELECT {sql_map(text.spellings())} AS m)""")
def r65c(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit(". "), F.lit("… “½” — ")), F.lit(", "), F.lit(" ﬁ™ № "))
    t = F.replace(F.replace(t, F.lit(" de "), F.lit("\u00a0Ǣ中🎉\u200b\x07")), F.lit(" the "), F.lit(" Ωǆ "))
    return table(spark, d, "documents").select("doc_id", text.downcode(t, text.spellings(), charrefs=True).alias("t"))


@query("r66_expand_unicode", r"""
SELECT doc_id, '"' || w || '" (' || array_to_string(list_transform(string_split(w, ''), lambda x: printf('U+%04X', unicode(x))), ' ') || ')' AS t
FROM (SELECT doc_id, text AS w FROM documents) WHERE w <> ''""")
def r66(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("w")).filter("w <> ''")
    return rows.select("doc_id", text.expand_unicode(F.col("w")).alias("t"))


def sql_names(*ranges: tuple[int, int]) -> str:
    """Rows of characters and their names, for the code points of some ranges."""
    codes = [x for lo, hi in ranges for x in range(lo, hi) if unicodedata.name(chr(x), "")]
    return ", ".join(f"({x}, '{unicodedata.name(chr(x))}')" for x in codes)


@query("r66_character_names", f"""
WITH names(code, name) AS (VALUES {sql_names((0, 0x250), (0x2000, 0x2070), (0x20A0, 0x20C0))}),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
j AS (SELECT doc_id, string_agg(coalesce(name, printf('U+%04x', unicode(c))), ', ' ORDER BY i) AS names FROM c LEFT JOIN names ON code = unicode(c) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE names END AS names FROM documents LEFT JOIN j USING (doc_id)""")
def r66b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", helpers.character_names(F.col("text")).alias("names"))


@query("r67_bcp14_terms", r"""
SELECT doc_id, array_to_string(regexp_extract_all(t, '\b(MUST NOT|MUST|REQUIRED|SHALL NOT|SHALL|SHOULD NOT|SHOULD|NOT RECOMMENDED|RECOMMENDED|MAY|OPTIONAL)\b', 1), ',') AS terms,
  first IN ('MUST NOT', 'MUST', 'REQUIRED', 'SHALL NOT', 'SHALL', 'SHOULD NOT', 'SHOULD', 'NOT RECOMMENDED', 'RECOMMENDED', 'MAY', 'OPTIONAL') AS valid
FROM (SELECT doc_id, replace(replace(replace(text, ' the ', ' MUST NOT '), ' de ', ' SHOULD '), ' of ', ' MAY ') AS t,
  trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN ' MUST  NOT' WHEN 1 THEN 'Must' ELSE 'MAY' || chr(10) END, '[\s\x{A0}]+', ' ', 'g')) AS first FROM documents)""")
def r67(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" MUST NOT ")), F.lit(" de "), F.lit(" SHOULD ")), F.lit(" of "), F.lit(" MAY "))
    first = F.when(F.col("doc_id") % 3 == 0, " MUST  NOT").when(F.col("doc_id") % 3 == 1, "Must").otherwise("MAY\n")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.keywords_in(t), ",").alias("terms"), text.is_keyword(first).alias("valid"))


@query("r69_list_label", r"""
WITH n AS (SELECT DISTINCT l_linenumber + 26 * (l_orderkey % 40) AS n FROM lineitem), a AS (
  SELECT n, n - 1 AS m, n // 1000 AS k, (n // 100) % 10 AS h, (n // 10) % 10 AS t, n % 10 AS u FROM n)
SELECT n, (CASE WHEN m >= 676 THEN chr(CAST(97 + m // 676 AS INTEGER)) ELSE '' END) || (CASE WHEN m >= 26 THEN chr(CAST(97 + (m // 26) % 26 AS INTEGER)) ELSE '' END) || chr(CAST(97 + m % 26 AS INTEGER)) AS letters,
  ['', 'm', 'mm', 'mmm'][CAST(k + 1 AS INTEGER)] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][CAST(h + 1 AS INTEGER)] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(t + 1 AS INTEGER)] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(u + 1 AS INTEGER)] AS roman,
  printf('%o', n) AS octal, printf('%X', n) AS hex, 'p.' || n || ')' AS formatted FROM a""")
def r69(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select((F.col("l_linenumber") + 26 * (F.col("l_orderkey") % 40)).alias("n")).distinct()
    c = F.col("n")
    return n.select("n", text.list_label(c, "a").alias("letters"), text.list_label(c, "i").alias("roman"), text.list_label(c, "o").alias("octal"), text.list_label(c, "X").alias("hex"), text.formatted_label(c, "%p.%d)", F.lit("p")).alias("formatted"))


@query("r81_long_lines", r"""
SELECT doc_id, i AS line_no, length(l) - 72 AS excess FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(l) > 72""")
def r81(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(text.long_lines_of(F.col("text"))).alias("l"))
    return rows.select("doc_id", F.col("l.line_no").cast("long").alias("line_no"), F.col("l.excess").cast("long").alias("excess"))


@query("r78_code_blocks", r"""
WITH t AS (SELECT doc_id, '<CODE BEGINS> file "f' || doc_id || '.c"' || chr(10) || text || chr(10) || '<CODE ENDS>' || (CASE WHEN doc_id % 5 = 0 THEN ' more' ELSE '' END) AS t FROM documents)
SELECT doc_id, regexp_extract(t, '(?s)<CODE BEGINS>(?: file "([^"]*)")?\n(.*?)\n?<CODE ENDS>', 1) AS file, regexp_extract(t, '(?s)<CODE BEGINS>(?: file "([^"]*)")?\n(.*?)\n?<CODE ENDS>', 2) AS code,
  CASE WHEN doc_id % 5 = 0 THEN 'trailing text' END AS problem FROM t""")
def r78(spark: SparkSession, d: str) -> DataFrame:
    made = text.emit_code_markers(F.col("text"), F.concat(F.lit("f"), F.col("doc_id"), F.lit(".c")))
    t = table(spark, d, "documents").select("doc_id", F.concat(made, F.when(F.col("doc_id") % 5 == 0, " more").otherwise("")).alias("t"))
    return t.select("doc_id", F.explode(text.extract_code_blocks(F.col("t"))).alias("b"), text.code_marker_problem(F.col("t")).alias("problem")).select("doc_id", "b.file", "b.code", "problem")


@query("r78_open_code_blocks", """
SELECT doc_id, 'f' || doc_id || '.c' AS file, text AS code, 'missing end' AS problem FROM documents WHERE text IS NOT NULL""")
def r78b(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that no marker closes: their code goes on to the end of the text."""
    made = F.concat(F.lit('<CODE BEGINS> file "f'), F.col("doc_id"), F.lit('.c"\n'), F.col("text"))
    t = table(spark, d, "documents").select("doc_id", made.alias("t"))
    return t.select("doc_id", F.explode(text.extract_code_blocks(F.col("t"))).alias("b"), text.code_marker_problem(F.col("t")).alias("problem")).select("doc_id", "b.file", "b.code", "problem")


@query("r79_wrap_text")
def r79(spark: SparkSession, d: str) -> DataFrame:
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para", "p"))
    return paras.select("doc_id", "para", helpers.wrap_text(F.col("p")).alias("lines")).select("doc_id", "para", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("wrapped"))


@query("r80_justify", r"""
WITH j AS (SELECT c_custkey, c_name AS l, c_mktsegment AS m, CAST(c_nationkey AS VARCHAR) AS r FROM customer), p AS (
  SELECT c_custkey, l, m, r, CAST(floor((CASE WHEN length(m) % 2 = 0 THEN 72 - length(m) ELSE 73 - length(m) END) / 2) AS INTEGER) AS b FROM j)
SELECT c_custkey, rpad(l, b, ' ') || m || lpad(r, CAST(72 - b - length(m) AS INTEGER), ' ') AS line, repeat(' ', greatest(72 - greatest(length(l), length(m)), 0)) || l || chr(10) || repeat(' ', greatest(72 - greatest(length(l), length(m)), 0)) || m AS block,
  '   ' || l || chr(10) || '     ' || m AS indented FROM p""")
def r80(spark: SparkSession, d: str) -> DataFrame:
    two = F.array("c_name", "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", text.justify_line(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("line"), F.array_join(text.align_block(two, "right"), "\n").alias("block"), F.array_join(text.indent_block(two, 3, 2), "\n").alias("indented"))


@query("r86_uniq_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def r86(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return windows.uniq_first(keyed, keys=["digest"], order=["doc_id"])


@query("r88_compare_corpora", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT doc_id, line, count(*) AS n FROM l WHERE NOT regexp_matches(line, '^Released under') GROUP BY ALL),
w AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, CASE WHEN i % 7 = 0 THEN 'x' || line WHEN i % 11 = 0 THEN line || '!' ELSE line END AS line FROM l) WHERE NOT regexp_matches(line, '^Released under') GROUP BY ALL),
j AS (SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, coalesce(o.line, w.line) AS line, coalesce(w.n, 0) - coalesce(o.n, 0) AS d FROM o FULL JOIN w ON o.doc_id = w.doc_id AND o.line = w.line)
SELECT doc_id, line, CASE WHEN d > 0 THEN 'new' ELSE 'old' END AS side, abs(d) AS n FROM j WHERE d <> 0""")
def r88(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    nth = F.col("i") + 1
    new = lines.withColumn("line", F.when(nth % 7 == 0, F.concat(F.lit("x"), "line")).when(nth % 11 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return windows.compare_corpora(lines, new, key="doc_id", line="line", ignore="^Released under")


@query("r17_silence_findings", r"""
SELECT doc_id, i AS line_no, l AS message FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE NOT (starts_with(l, 'The ') OR regexp_matches(l, '^(?:The )') OR starts_with(l, '[A-D]') OR regexp_matches(l, '^(?:[A-D])') OR starts_with(l, '(unclosed'))""")
def r17(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "message"))
    return silence_findings(lines, ["Warning: The ", "[A-D]", "(unclosed"]).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "message")


@query("r53_plain_pages", r"""
SELECT doc_id, i AS line_no, (i - 1) // 48 + 1 AS page FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def r53(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    return windows.plain_pages(lines, doc="doc_id", pos="i").select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.col("page").cast("long").alias("page"))


#: Lines of 30 characters: a paragraph's lines are a block, a blank line stands between two. Some begin with a heading, some are figures.
LINES = r"""
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
q AS (SELECT *, greatest((length(t) + 29) // 30, 1) AS n FROM p),
o AS (SELECT *, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY p) - n - 1 AS above, max(p) OVER (PARTITION BY doc_id) AS last FROM q),
k AS (SELECT *, unnest(range(n + 1)) AS k FROM o),
lines AS (
  SELECT doc_id AS doc, CAST(above + k AS BIGINT) AS line, k = n OR trim(substr(t, 30 * k + 1, 30)) = '' AS blank, CASE WHEN k < n THEN p END AS block,
    CASE WHEN k = n THEN NULL WHEN p % 7 = 0 AND k = 0 THEN 'section' WHEN p % 5 = 3 THEN 'figure' ELSE 't' END AS tag
  FROM k WHERE NOT (k = n AND p = last))"""
#: The pages of ``lines``.
PAGES = """
n AS (SELECT doc, max(line) + 1 AS n FROM lines GROUP BY doc),
b AS (SELECT doc, block, min(line) AS beg, max(line) + 1 AS stop, arg_min(tag, line) AS kind FROM lines WHERE block IS NOT NULL GROUP BY doc, block),
c AS (
  SELECT l.*, beg, stop, kind, coalesce(sum(CASE WHEN tag <> 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc, l.block ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    list(coalesce(tag = 'section', false)) OVER (PARTITION BY l.doc ORDER BY line ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS flags,
    min(CASE WHEN NOT blank THEN line END) OVER (PARTITION BY l.doc ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
  FROM lines l LEFT JOIN b ON l.doc = b.doc AND l.block = b.block),
u AS (SELECT *, list_reduce(list_prepend(0, range(1, 15)), lambda d, j: CASE WHEN coalesce(flags[-j], false) AND j - d <= 3 AND d < 12 THEN j ELSE d END) AS up FROM c),
m AS (
  SELECT s.doc, s.line, t.line AS due, CASE
    WHEN t.block IS NULL THEN t.line - t.up
    WHEN t.kind = 'section' THEN CASE WHEN t.before <= 5 THEN t.beg ELSE t.line END
    WHEN t.kind IN ('artset', 'artwork', 'figure', 'sourcecode', 'table') THEN CASE WHEN t.stop - t.beg < 48 OR t.line - t.beg <= 5 THEN t.beg ELSE t.line END
    WHEN (t.line - t.beg BETWEEN 1 AND 2 AND t.stop - t.beg > t.line - t.beg) OR (t.stop - t.line BETWEEN 1 AND 2 AND t.stop - t.beg > t.stop - t.line) THEN t.beg
    ELSE t.line END AS moved
  FROM u s JOIN u t ON t.doc = s.doc AND t.line = s.line + CASE WHEN s.line = 0 THEN 52 ELSE 48 END),
j AS (SELECT doc, line, CASE WHEN moved > line THEN moved ELSE due END AS stop FROM m),
w AS (
  SELECT doc, CAST(0 AS BIGINT) AS line, 1 AS page FROM n
  UNION ALL SELECT w.doc, c.filled, w.page + 1 FROM w JOIN j ON w.doc = j.doc AND w.line = j.line JOIN c ON c.doc = j.doc AND c.line = j.stop WHERE c.filled IS NOT NULL),
spans AS (SELECT w.doc, w.page, w.line AS first, coalesce(j.stop, n.n) AS stop FROM w JOIN n ON w.doc = n.doc LEFT JOIN j ON w.doc = j.doc AND w.line = j.line),
paged AS (SELECT l.doc, l.line, coalesce(s.page, 0) AS page FROM lines l LEFT JOIN spans s ON l.doc = s.doc AND l.line >= s.first AND l.line < s.stop)"""


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """What :data:`LINES` says, and the ``title`` of each heading. Of a paragraph's text only its size, its blank lines and its first line are dealt by document."""
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "t"))
    size = F.greatest(F.floor((F.length("t") + 29) / 30), F.lit(1))
    blank = F.filter(F.sequence(F.lit(0).cast("long"), size - 1), lambda k: F.trim(F.substr("t", (30 * k + 1).cast("int"), F.lit(30))) == "")
    may_be = (F.col("t") == "") | F.endswith("t", F.lit(" ")) | F.contains("t", F.lit(" " * 30))  # else no line is blank
    paras = paras.select("doc_id", "p", size.alias("n"), F.when(may_be, blank).alias("blanks"), F.when(F.col("p") % 7 == 0, F.substring("t", 1, 30)).alias("head"))
    own = W.partitionBy("doc_id")
    paras = paras.withColumn("above", F.sum(F.col("n") + 1).over(own.orderBy("p")) - F.col("n") - 1).withColumn("last", F.max("p").over(own))
    rows = paras.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("p") == F.col("last"), F.col("n") - 1).otherwise(F.col("n")))))
    inside = F.col("k") < F.col("n")
    tag = F.when((F.col("p") % 7 == 0) & (F.col("k") == 0), "section").when(F.col("p") % 5 == 3, "figure").otherwise("t")
    return rows.select(
        F.col("doc_id").alias("doc"), (F.col("above") + F.col("k")).alias("line"), (~inside | F.coalesce(F.array_contains("blanks", F.col("k")), F.lit(False))).alias("blank"),
        F.when(inside, F.col("p")).alias("block"), F.when(inside, tag).alias("tag"), F.when(F.col("k") == 0, F.col("head")).alias("title"),
    )


@query("r53_assign_pages", f"WITH RECURSIVE {LINES}, {PAGES} SELECT doc AS doc_id, line, page FROM paged")
def r53b(spark: SparkSession, d: str) -> DataFrame:
    out = pages.paginate(text_lines(spark, d), doc="doc", line="line", blank="blank", block="block", tag="tag")
    return out.withColumnRenamed("doc", "doc_id")


@query("r56_paged_contents", f"""
WITH RECURSIVE {LINES.replace("lines AS (", "body AS (")},
h AS (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY line) AS nth, count(*) OVER (PARTITION BY doc) AS m FROM body WHERE tag = 'section'),

lines AS (
  SELECT doc, line + coalesce((SELECT max(m) + 1 FROM h WHERE h.doc = body.doc), 0) AS line, blank, block, tag FROM body
  UNION ALL SELECT doc, nth - 1, false, -1, 'toc' FROM h UNION ALL SELECT doc, max(m), true, NULL, NULL FROM h GROUP BY doc), {PAGES},
title AS (SELECT doc_id AS doc, substr(t, 1, 30) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS nth FROM o WHERE p % 7 = 0)
SELECT h.doc AS doc_id, h.nth, title, g.page, e.page AS entry_page
FROM h JOIN title ON title.doc = h.doc AND title.nth = h.nth JOIN paged g ON g.doc = h.doc AND g.line = h.line + h.m + 1 JOIN paged e ON e.doc = h.doc AND e.line = h.nth - 1""")
def r56b(spark: SparkSession, d: str) -> DataFrame:
    return pages.paged_contents(text_lines(spark, d), doc="doc", line="line", blank="blank", block="block", tag="tag", title="title").withColumnRenamed("doc", "doc_id")


@query("r53_wrapped_pages")
def r53c(spark: SparkSession, d: str) -> DataFrame:
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "p"))
    lines = paras.select("doc_id", "block", F.posexplode(helpers.wrap_text(F.col("p"))).alias("k", "t"))
    lines = lines.select("doc_id", (F.col("block").cast("long") * 1_000_000 + F.col("k")).alias("pos"), "block", "t", F.lit(False).alias("keep"))
    return helpers.assign_pages(lines, doc="doc_id", pos="pos", text="t", block="block", keep="keep")


#: Scripts that the ranges tell apart.
TOLD_APART = ("Arabic", "Armenian", "Bengali", "Common", "Cyrillic", "Devanagari", "Greek", "Han", "Hangul", "Hebrew", "Hiragana", "Inherited", "Katakana", "Latin", "Thai")


@query("r29_script_of_codepoints", f"""
SELECT doc_id, ch AS char, CASE {" ".join(f"WHEN regexp_matches(ch, '{chr(92)}p{{{x}}}') THEN '{x}'" for x in TOLD_APART)} ELSE 'Unknown' END AS script
FROM (SELECT DISTINCT doc_id, unnest(string_split(text || chr(CAST(161 + doc_id * 37 % 900 AS INTEGER)) || chr(CAST(19968 + doc_id % 20000 AS INTEGER)) || chr(CAST(12353 + doc_id % 80 AS INTEGER)), '')) AS ch FROM documents) WHERE ch <> ''""")
def r29(spark: SparkSession, d: str) -> DataFrame:
    """Every text gets a character of some other block, one ideograph and one kana, so that ranges of many scripts are met."""
    ranges = joins.script_ranges(spark, TOLD_APART, upto=0x10000)
    more = [161 + F.col("doc_id") * 37 % 900, 19968 + F.col("doc_id") % 20000, 12353 + F.col("doc_id") % 80]
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", *[joins.character(c) for c in more]).alias("text"))
    return joins.script_of_codepoints(docs, ranges)


@query("r24_lookup_with_fallback", r"""
WITH q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Item.' || (doc_id % 60) || '.xml' ELSE 'item.' || (doc_id % 60) END AS name FROM documents),
l AS (SELECT 'item.' || (CASE WHEN item_id % 2 = 0 THEN item_id ELSE -item_id END) || '.xml' AS name, 1 AS priority, item_id FROM benchmark UNION ALL SELECT 'ITEM.' || item_id, 2, item_id + 1000 FROM benchmark)
SELECT q.doc_id, q.name, b.priority, b.item_id FROM q LEFT JOIN (
  SELECT lower(regexp_replace(name, '\.xml$', '')) AS k, priority, item_id FROM l QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(name, '\.xml$', '')) ORDER BY priority) = 1) b
ON lower(regexp_replace(q.name, '\.xml$', '')) = b.k""")
def r24(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.joins import lookup_with_fallback

    n = F.col("doc_id") % 60
    req = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Item."), n, F.lit(".xml"))).otherwise(F.concat(F.lit("item."), n)).alias("name"))
    b = table(spark, d, "benchmark")
    lib = b.select(F.concat(F.lit("item."), F.when(F.col("item_id") % 2 == 0, F.col("item_id")).otherwise(-F.col("item_id")), F.lit(".xml")).alias("file"), F.lit(1).alias("priority"), "item_id")
    lib = lib.unionByName(b.select(F.concat(F.lit("ITEM."), "item_id").alias("file"), F.lit(2).alias("priority"), (F.col("item_id") + 1000).alias("item_id")))
    return lookup_with_fallback(req, lib, key="name", name="file", priority="priority")
