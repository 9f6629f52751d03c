"""The queries of the ten operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, license_scan, mixing, ngram_join, quality_classifier, quality_rules, token_counts, token_files, toxicity, warc

COUNTED, ENCODED = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), path or vocabulary(COUNTED))


def op5_token_files(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), path or vocabulary(ENCODED))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_mixing, op3_ngram_join, op4_token_counts, op5_token_files, op6_warc, op7_toxicity, op8_decontamination, op9_quality_classifier, op10_license_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL}
