"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, fingerprints, importance, langid, linededup, mixing, neardup, oracles, quality, suffixes, toxicity, urls, warc
from tessera.runtime import load


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load(spark, sf_dir, "documents"))


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(load(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(load(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(load(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_recurring(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(load(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_report(load(spark, sf_dir, "documents"))


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(load(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark texts and the ranks of the drawn ones; see importance.resampling_report."""
    return importance.resampling_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of any string of 200 bytes that starts more than once; see suffixes.substring_report."""
    return suffixes.substring_report(load(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_edit_fingerprints, op3_quality_rules, op4_warc_archive, op5_toxicity, op6_line_dedup, op7_language_id, op8_bpe_round_trip, op9_filter_urls, op10_minhash_near_dedup, op11_importance_resampling, op12_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": oracles.MIX, "op3_quality_rules": oracles.QUALITY, "op4_warc_archive": oracles.WARC, "op9_filter_urls": oracles.URLS, "op11_importance_resampling": oracles.RESAMPLING}
