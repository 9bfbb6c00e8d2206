"""Chat formatting: logs of conversation events folded into final messages, rendered, and read back. DataFrame functions only.

An event is (conversation, sequence, kind, turn, role, text). Kinds:

- ``message``: the turn is this text from now on
- ``delta``: the text is appended to the turn
- ``edit``: as ``message``, and all later turns go, for they answered another text
- ``regenerate``: the turn and all later ones go; ``delta`` events that follow build it anew

The fold needs no loop: events go if an earlier turn was edited or regenerated after them; of those left, a turn begins at
its last ``message``, ``edit`` or ``regenerate``, or else its first one, and what it has from there joins in sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What no text may hold as it is, so that nothing in it can be taken for the template or for another one's marks.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c: Column) -> Column:
    r"""``\`` doubled, and one ``\`` put into each control string after its first character."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        c = F.replace(c, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return c


def unescape(c: Column) -> Column:
    r"""The inverse of :func:`escape`: ``\`` and any character are that character."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame, *, conv_col: str = "conv_id", seq_col: str = "seq", kind_col: str = "kind", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Final messages: ``conv_id``, ``turn``, ``role``, ``text``, one row for each turn that is left.

    Events that repeat in all these columns (a log delivered twice) count once. Events of one turn and sequence apply in
    the order of kind, role and text. Null texts are empty; a null kind is ``message``; a null role counts as '', and a
    turn's role is the first that its events give. A null conversation or turn is a value of its own, first in order. A
    turn of deltas alone begins at its first one. Other columns are dropped.

    One shuffle, by conversation: both windows and both groupings use it. Windows spill, so a conversation with very many
    events needs time in one task, not memory; its final text is one value and must fit in a row.
    """
    e = events.select(
        F.col(conv_col).alias("conv_id"), F.col(seq_col).alias("seq"), F.coalesce(F.col(kind_col), F.lit("message")).alias("kind"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct()
    starts, cuts = F.col("kind").isin("message", "edit", "regenerate"), F.col("kind").isin("edit", "regenerate")
    earlier = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(cuts, F.col("seq"))).over(earlier)).filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    of_turn = W.partitionBy("conv_id", "turn")
    e = e.withColumn("began", F.coalesce(F.max(F.when(starts, F.col("seq"))).over(of_turn), F.min("seq").over(of_turn))).filter(F.col("seq") >= F.col("began"))
    part = F.struct("seq", F.when(starts, 0).otherwise(1).alias("o"), "kind", "role", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))
    turns = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(part)).alias("p"))
    role = F.coalesce(F.get(F.filter("p", lambda x: x["role"] != ""), F.lit(0))["role"], F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss``: the spans [start, end) in code points whose text is trained on.

    Takes ``conv_id``, ``turn``, ``role``, ``text`` (as :func:`fold_events` gives them), sorted by turn, then role and
    text. Each turn is ``<|turn|>role<|text|>text<|end|>``, roles and texts escaped; a span covers one turn's escaped text.
    """
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": escape(F.col("text"))})
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumns({"n": F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")), "upto": F.sum(F.length("head") + F.length("body") + len(END)).over(order)})
    end = (F.col("upto") - len(END)).cast("int")
    span = F.when(F.col("role").isin(*loss_roles), F.struct((end - F.length("body")).alias("start"), end.alias("end")))
    convs = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")))).alias("m"))
    return convs.select("conv_id", F.array_join(F.col("m.piece"), "").alias("formatted"), F.array_compact(F.col("m.span")).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation, unescaped: an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda t: t.startswith(TURN))
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescape(F.substr(t, F.locate(TEXT, t) + len(TEXT))).alias("text")))


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages as a log: every row is a ``message`` of a turn of its own, in order of turn, role and text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("turn", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the rendered text."""
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = render(fold_events(as_events(conversations.select("conv_id", "turn", "role", "text").unionByName(more))))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("t"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2(F.col("t").cast("binary"), 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"), F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def _escaped_sql(c: str) -> str:
    c = rf"replace({c}, '\', '\\')"
    for mark in CONTROL:
        c = f"replace({c}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return c


ORACLE = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
         CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""
