"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into a Spark column.

Statistics are plain columns. Small trees grown on a bounded sample of labelled rows give conjunctive rules, one for each
path; a lasso-penalised logistic regression weighs them and sets most weights to zero; what is left becomes one expression.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import boxed, crc_fold, own_columns


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules may test, as columns of a text; null counts as empty. Shares are 0 for empty texts."""
    t = F.coalesce(text, F.lit(""))
    n, least = F.length(t), F.greatest(F.length(t), F.lit(1))
    share = lambda chars: (n - F.length(_without(t, chars))) / least
    words = F.split(t, " ", -1)
    lines = F.split(t, "\n", -1)
    n_words, n_lines = F.size(words), F.size(lines)
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_chars": n / n_words,
        "upper": share(string.ascii_uppercase),
        "digits": share(string.digits),
        "stops": share(".,;:?"),
        "shouts": share("!"),
        "symbols": share("#$%&*|<>{}[]_=+~^\\/@"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_words_by_length": F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n_words.cast("double")),
        "line_chars": F.log1p(n / n_lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
    }


@dataclass(frozen=True)
class RuleModel:
    """``bias`` plus the weight of each rule that holds; a rule is a tuple of (statistic, above, threshold)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as one expression."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for name, above, at in rule:
                test = stats[name] > at if above else stats[name] <= at
                holds = test if holds is None else holds & test
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


#: Thresholds tried for each statistic.
BINS = 32


def _paths(codes: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: tuple = (), least: int = 20) -> list[tuple]:
    """The rules of all nodes below the root of a tree: tuples of (statistic, above, bin).

    Each split takes the greatest fall of Gini impurity over half of the statistics, drawn anew, from counts per bin.
    """
    here, n = ([path] if path else []), len(y)
    if depth == 0 or n < 2 * least or y.min() == y.max():
        return here
    best = (1e-9, -1, -1)
    for f in rng.choice(codes.shape[1], size=-(-codes.shape[1] // 2), replace=False):
        left = np.cumsum(np.bincount(codes[:, f], minlength=BINS + 1))[:-1]
        ones = np.cumsum(np.bincount(codes[:, f], weights=y, minlength=BINS + 1))[:-1]
        right = n - left
        ok = (left >= least) & (right >= least)
        if ok.any():
            impure = ones - ones**2 / np.maximum(left, 1) + (y.sum() - ones) - (y.sum() - ones) ** 2 / np.maximum(right, 1)
            gain = np.where(ok, y.sum() - y.sum() ** 2 / n - impure, -1)
            if gain.max() > best[0]:
                best = (gain.max(), int(f), int(gain.argmax()))
    _, f, at = best
    if f < 0:
        return here
    left = codes[:, f] <= at
    for above, rows in ((False, left), (True, ~left)):
        here = here + _paths(codes[rows], y[rows], depth - 1, rng, (*path, (f, above, at)), least)
    return here


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression, by accelerated proximal gradient; the bias is free."""
    n, k = z.shape
    a = np.hstack([z, np.ones((n, 1), z.dtype)])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(k + 1)
    for i in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:k], float(w[k])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 16, depth: int = 3, penalty: float = 5e-4, steps: int = 300, seed: int = 7) -> RuleModel:
    """Fits on a sample in memory. Without rows every score is 1/2; with one label only, it is that label's smoothed share."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    rng, found = np.random.default_rng(seed), {}
    cuts = np.quantile(x, np.linspace(0.02, 0.98, BINS), axis=0)
    codes = np.stack([np.searchsorted(cuts[:, f], x[:, f]) for f in range(x.shape[1])], axis=1)  # x <= cuts[k] just where code <= k
    for _ in range(trees):
        rows = rng.integers(0, len(y), size=len(y))
        found |= dict.fromkeys(_paths(codes[rows], y[rows], depth, rng))
    rules = list(found)
    z = np.stack([np.logical_and.reduce([(codes[:, f] > k) == above for f, above, k in r]) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    rules = [tuple((names[f], above, float(cuts[k, f])) for f, above, k in r) for r in rules]
    w, bias = _lasso(z, y, penalty, steps)
    return RuleModel(bias, tuple((r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, held_out: tuple[int, int] = (4, 2), **how) -> RuleModel:
    """Learns from at most ``max_rows`` labelled rows outside the held-out fold, those with the smallest hash of their id.

    Rows whose crc32(id as text) modulo ``held_out[0]`` is ``held_out[1]`` are never seen, nor rows with a null label; labels
    above 0 are 1. Labels without a document, and documents without a label, play no part; the tables may be empty.
    """
    mod, fold = held_out
    seen = labels.filter(F.col(label_col).isNotNull() & (crc_fold(F.col(id_col), mod) != fold)).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("double").alias("_y"))
    seen = seen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    stats = statistics(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_doc"), text_col).join(F.broadcast(seen), F.col("_doc") == F.col("_id"))
    rows = rows.select(*[c.cast("double").alias(n) for n, c in stats.items()], "_y", "_id")
    sample = rows.orderBy(F.xxhash64("_id"), *stats, "_y").limit(max_rows).drop("_id").toArrow()
    x = np.stack([sample[n].to_numpy() for n in stats], axis=1) if sample.num_rows else np.zeros((0, len(stats)))
    return fit_rules(x, sample["_y"].to_numpy() if sample.num_rows else np.zeros(0), list(stats), **how)


def classify(docs: DataFrame, model: RuleModel, *, text_col: str = "text", threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the score and the prediction (1 from ``threshold`` up). No shuffle, no Python.

    Statistics pass through an explode of one element: a filter on the score stays above it, where they are computed
    already, instead of repeating them for each rule below.

    Null and empty texts are scored by their statistics like any other. Columns of the same names, in any case, are replaced.
    """
    return _scored(docs, model, text_col).select(*own_columns(docs, score_col, predicted_col), F.col("score").alias(score_col), (F.col("score") >= threshold).cast("int").alias(predicted_col))


def _scored(docs: DataFrame, model: RuleModel, text_col: str) -> DataFrame:
    stats = statistics(F.col(text_col))
    out = boxed(docs, **{n: c.cast("double") for n, c in stats.items()})
    out = out.select("row", F.explode(F.array(F.struct(*stats))).alias("stats"))
    return out.select("row", model.score({n: F.col("stats")[n] for n in stats}).alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns, whatever their names."""
    return _scored(docs, model, text_col).filter(F.col("score") >= threshold).select("row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = classify(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
