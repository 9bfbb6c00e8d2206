"""Checks as rules, all findings of a corpus in one table, and outputs of documents without errors."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.elements import silence_findings


@dataclass(frozen=True)
class Rule:
    """A check: where ``selector`` holds and ``check`` holds too, there is a finding.

    ``check`` is a Column, or a function from the selected rows to those found (for checks that need joins or windows).
    """

    selector: Column
    severity: str
    code: str
    check: Column | Callable[[DataFrame], DataFrame]
    message: Column | None = None


def run_rules(el: DataFrame, rules: Iterable[Rule], *, doc: str, node: str) -> DataFrame:
    """``doc``, ``node``, ``severity``, ``code``, ``message``. All rules of one element are evaluated in one pass over the rows."""
    rules = list(rules)
    flat = [r for r in rules if isinstance(r.check, Column)]
    parts = [el.select(doc, node, F.explode(found_by(flat)).alias("f")).select(doc, node, "f.*")] if flat else []
    parts += [r.check(el.filter(r.selector)).select(doc, node, F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), _message(r)) for r in rules if not isinstance(r.check, Column)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _message(r: Rule) -> Column:
    return (r.message if r.message is not None else F.lit(r.code)).alias("message")


def found_by(rules: Iterable[Rule]) -> Column:
    """What rules of an element alone find in it: an array of ``severity``, ``code``, ``message``."""
    return F.array_compact(F.array(*[F.when(r.selector & r.check, F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), _message(r))) for r in rules]))


@dataclass(frozen=True)
class Relations:
    """What the checks that compare an element with others of its document need of it; each may be null.

    ``link``: an address, to be named once. ``name``: an id, or what a reference (``refers``) points to. ``opens``: it begins a
    section, which must not hold both ``block`` and ``text``. ``agree``: a value that all that have one must share.
    ``numbered``: whether a section has a number, which none may have after one without.
    """

    link: Column
    name: Column
    refers: Column
    opens: Column
    block: Column
    text: Column
    agree: Column
    numbered: Column


#: Severities of findings about relations.
SEVERITIES = {"duplicate-link": "error", "unresolved": "error", "unused": "warning", "mixed-content": "warning", "inconsistent": "error", "unnumbered-order": "error"}


def lint_elements(el: DataFrame, rules: Iterable[Rule], relations: Relations, *, doc: str, node: str, more: Iterable[Column] = (), severities: dict[str, str] | None = None, silence: Iterable[str] = ()) -> DataFrame:
    """All checks of a corpus: ``doc``, ``node``, ``severity``, ``code``, ``message``.

    Rules of one element (``more``: arrays of findings) are one expression over it, evaluated where it is read; what they find stays there. Only elements that any of
    ``relations`` says something of are dealt by document, with those few short columns, and every other check is a window within that: no task sorts what
    rules found, or texts.
    """
    given, r = SEVERITIES | (severities or {}), relations
    say = lambda when, code, *message: F.when(when, F.struct(F.lit(given[code]).alias("severity"), F.lit(code).alias("code"), F.concat(*message).alias("message")))
    alone = el.select(F.col(doc).alias("doc"), F.col(node).alias("node"), F.explode(F.concat(found_by(rules), *more)).alias("f"))
    alone = alone.select("doc", "node", "f.severity", "f.code", "f.message")
    parts = {"link": r.link, "name": r.name, "refers": r.refers, "opens": r.opens, "block": r.block, "text": r.text, "agree": r.agree, "numbered": r.numbered}
    rows = el.select(F.col(doc).alias("doc"), F.col(node).alias("node"), *[c.alias(k) for k, c in parts.items()])
    rows = rows.filter("link IS NOT NULL OR name IS NOT NULL OR refers IS NOT NULL OR opens OR block OR text OR agree IS NOT NULL OR numbered IS NOT NULL").repartition("doc")
    ordered, whole = W.partitionBy("doc").orderBy("node"), W.partitionBy("doc")
    rows = rows.select(
        "*", F.coalesce(F.max(F.when(F.col("opens"), F.col("node"))).over(ordered), F.lit(0)).alias("sect"),
        F.max(~F.col("numbered")).over(ordered.rowsBetween(W.unboundedPreceding, -1)).alias("late"),
        F.min("agree").over(whole).alias("least"), F.max("agree").over(whole).alias("most"), F.min(F.when(F.col("agree").isNotNull(), F.col("node"))).over(whole).alias("first"),
    )
    # what is settled goes on as two flags
    rows = rows.select(
        "doc", "node", "sect", "link", "name", "refers", "block", "text",
        ((F.col("least") != F.col("most")) & (F.col("node") == F.col("first"))).alias("differ"), (F.col("numbered") & F.col("late")).alias("disorder"),
    )
    section = W.partitionBy("doc", "sect")
    mixed = F.max("block").over(section) & F.max("text").over(section) & (F.col("node") == F.min("node").over(section))
    rows = rows.select("doc", "node", "sect", "link", "name", "refers", "differ", "disorder", mixed.alias("mixed"))
    rows = rows.filter("link IS NOT NULL OR name IS NOT NULL OR refers IS NOT NULL OR differ OR disorder OR mixed")
    named = W.partitionBy("doc", "name")
    rows = rows.select(
        "*", F.max(~F.col("refers")).over(named).alias("there"), F.max("refers").over(named).alias("meant"),
        F.row_number().over(W.partitionBy("doc", "link").orderBy("node")).alias("nth"),
    )
    here = F.array(
        say(F.col("link").isNotNull() & (F.col("nth") > 1), "duplicate-link", F.lit("Link to "), "link", F.lit(" again")),
        say(F.col("refers") & ~F.col("there"), "unresolved", F.lit("Nothing is named "), "name"),
        say(~F.col("refers") & ~F.col("meant"), "unused", F.lit("Nothing refers to "), "name"),
        say(F.col("differ"), "inconsistent", F.lit("Values that must agree differ")),
        say(F.col("disorder"), "unnumbered-order", F.lit("Numbered after one without a number")),
    )
    at = lambda n, f: F.transform(f, lambda x: F.struct(n.alias("node"), x["severity"].alias("severity"), x["code"].alias("code"), x["message"].alias("message")))
    of_sections = F.array_compact(F.array(say(F.col("mixed"), "mixed-content", F.lit("Blocks and text in one section"))))
    related = rows.select("doc", F.explode(F.concat(at(F.col("node"), F.array_compact(here)), at(F.col("sect"), of_sections))).alias("f")).select("doc", "f.*")
    out = alone.unionByName(related)
    return silence_findings(out.select(F.col("doc").alias(doc), F.col("node").alias(node), "severity", "code", "message"), silence)


def lint(findings: Iterable[DataFrame], *, silence: Iterable[str] = ()) -> DataFrame:
    """The union of checks' findings, without those that a pattern silences."""
    out = None
    for f in findings:
        out = f if out is None else out.unionByName(f)
    return silence_findings(out, silence)


def without_errors(docs: DataFrame, findings: DataFrame, *, doc: str) -> DataFrame:
    """Documents without any finding of severity error: only those get an output."""
    return docs.join(findings.filter("severity = 'error'").select(doc).distinct(), doc, "left_anti")
