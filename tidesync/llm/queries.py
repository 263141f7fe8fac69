"""Registered queries of the corpus operators: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidesync.llm import (
    divergence,
    exact_dedup,
    html_extract,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    url_filter,
)
from tidesync.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(spark, table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark, table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_per_document(spark, table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept_text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(spark, table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spark, table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spark, table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spark, table(spark, sf_dir, "documents"))


REGISTRY: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_html_extract, op3_mixing, op4_exact_dedup, op5_substring_dedup,
        op6_toxicity, op7_quality, op8_url_filter, op9_packing, op10_pii,
        op11_simhash, op12_spelling, op13_divergence,
    )
}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_quality": quality.oracle_sql(),
    "op8_url_filter": url_filter.oracle_sql(),
    "op12_spelling": spelling.oracle_sql(),
    "op13_divergence": divergence.ORACLE_SQL,
}
