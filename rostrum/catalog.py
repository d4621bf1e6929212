"""The tables of a dataset folder as DataFrames or temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; Catalyst prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a stream of its files; a pattern, since a single file is no base path of a stream."""
    path = table_path(sf_dir, name)
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files make fewer partitions than that; large tables stay where they are.

    For work on texts that costs far more than moving them.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
