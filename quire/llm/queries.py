"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import align, chat, decontaminate, fingerprint, jaccard_join, line_dedup, lm, main_text, packing, quality, token_counts, token_files, variants
from quire.llm.common import scratch, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"), keep=()))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), scratch(spark))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.digest(table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_hpylm": op2_hpylm,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_fingerprint": op6_fingerprint,
    "op7_chat_format": op7_chat_format,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_main_text": op12_main_text,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op13_spelling_variants": variants.ORACLE,
}
