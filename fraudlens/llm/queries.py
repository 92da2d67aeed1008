"""Registered queries of this subpackage: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudlens.llm import (decontam, html_extract, mixing, neighbours, quality, secret_scan, sharding, simhash, spelling,
                           token_counts, token_output, warc, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(report: Callable[[DataFrame], DataFrame], table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(_table(spark, sf_dir, table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": _over(mixing.report, "documents"),
    "op2_host_quality": _over(quality.report, "documents"),
    "op3_token_counts": _over(token_counts.report, "documents"),
    "op4_byte_shards": _over(sharding.report, "documents"),
    "op5_simhash_dedup": _over(simhash.report, "documents"),
    "op6_secret_scan": _over(secret_scan.report, "documents"),
    "op7_warc_archive": _over(warc.report, "pages"),
    "op8_html_main_text": _over(html_extract.report, "pages"),
    "op9_decontamination": lambda spark, sf_dir: decontam.report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
    "op10_token_files": _over(token_output.report, "documents"),
    "op11_whitening": _over(whitening.report, "embeddings"),
    "op12_nearest_neighbours": _over(neighbours.report, "embeddings"),
    "op13_spelling_variants": _over(spelling.report, "documents"),
}

ORACLE_SQL: dict[str, str] = {
    "op2_host_quality": quality.ORACLE,
    "op4_byte_shards": sharding.ORACLE,
    "op7_warc_archive": warc.ORACLE,
}
