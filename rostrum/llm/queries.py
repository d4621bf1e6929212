"""The opN queries over whole tables and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from . import fill_middle, filter_audit, html_text, mixing, neighbours, packing, pieces, quality, shards, simhash, substrings, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [x.split()[0] for x in quality.STATS.split(", ")]
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *names, "base_failed", "kept", F.round("distance2", 6).alias("distance2"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_source_mixing,
        op3_simhash_near_dedup,
        op4_substring_dedup,
        op5_token_files,
        op6_nearest_neighbours,
        op7_sharding,
        op8_url_filter,
        op9_html_main_text,
        op10_quality_outliers,
        op11_fill_middle,
        op12_filter_audit,
        op13_sentence_pieces,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": mixing.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
