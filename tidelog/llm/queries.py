"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import exact_dedup, langid, license_scan, packing, pieces, quality_model, quality_rules, simhash, substring, url_filter
from tidelog.llm.common import documents


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir), keep="digest")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judge_language(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages, url_filter.BASE_RULES + url_filter.METHOD_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_simhash_near_dedup, op2_quality_classifier, op3_license_scan, op4_exact_dedup, op5_quality_rules, op6_sentencepiece, op7_substring_dedup,
        op8_language_id, op9_packing, op10_url_filter,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.oracle(),
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op7_substring_dedup": substring.ORACLE,
        "op10_url_filter": url_filter.oracle(),
    }
