"""Documents to packed training sequences, in five stages over everything the stage before kept.

A stage's result is to be written before the next stage starts, as ``run`` does: the working files it is
read from are deleted then.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rostrum.catalog import table
from rostrum.llm import mixing, near_copies, packing, quality, substrings
from rostrum.session import MADE, drop_path, drop_scratch, scratch


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


_left: list[str] = []


def _tidy(stage):
    """``stage``, after the working files of the stage before are deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop_path(spark, _left.pop())
        before = len(MADE)
        out = stage(spark, docs, sf_dir)
        _left.extend(MADE[before:])
        return out

    return run_stage


STAGES = [
    ("quality rules", _tidy(drop_low_quality)),
    ("near-duplicates", _tidy(drop_near_duplicates)),
    ("repeated passages", _tidy(cut_repeated_passages)),
    ("source mix", _tidy(mix_sources)),
    ("packing", _tidy(pack)),
]

#: Fingerprints, byte windows and tokenisation are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        old, docs = docs, scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop_scratch(old)
    while _left:
        drop_path(spark, _left.pop())
    return docs
