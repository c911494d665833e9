"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import classifier, decontam, mixture, oracles, packing, rules, sanitise, secret_scan, simhash, suffix_dedup, warc
from scholia.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.scored(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_mixture": op2_mixture,
        "op3_simhash": op3_simhash,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_sanitisation": op6_sanitisation,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_packing": op8_token_packing,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_warc_derivatives": op10_warc_derivatives,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
