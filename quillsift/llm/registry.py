"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import chat_format, decontaminate, line_dedup, lm_score, near_dedup, packing, quality_model, quality_rules, secret_scan, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.spans(table(spark, sf_dir, "conversations"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_index(table(spark, sf_dir, "pages"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def line_store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German and French documents come first, the others next; then the French ones go."""
    return line_dedup.after_deletion(table(spark, sf_dir, "documents"), F.col("lang").isin("de", "fr"), F.col("lang") == "fr")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_near_dedup, op3_quality_model, op4_packing, op5_warc_normalise, warc_round_trip, op6_decontaminate, op7_line_dedup, line_store_delete, op8_secret_scan, op9_quality_rules, op10_lm_score)}


def oracle_sql() -> dict[str, str]:
    return {"warc_round_trip": warc.ROUND_TRIP_ORACLE, "op1_chat_format": chat_format.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "line_store_delete": line_dedup.DELETION_ORACLE}
