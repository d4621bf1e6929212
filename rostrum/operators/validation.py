"""Data-quality operators: rejects carry a reason, batches are never dropped for one bad row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad with reason): the first rule that does not hold names the reason; null counts as not holding."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def valid_tags(tags: DataFrame, vocabulary: DataFrame, single: list[str]) -> DataFrame:
    """Tags (arg, grp, tag) that are known; a single-choice group with several tags is dropped whole."""
    known = tags.join(vocabulary, "tag", "left_semi").select("arg", "grp", "tag")
    # Only single-choice groups are counted; of a null group a lone tag stays.
    counted = F.coalesce(F.col("grp").isin(single), F.lit(True))
    n = F.count("*").over(Window.partitionBy("arg", "grp"))
    return known.where(~counted).unionByName(known.where(counted).withColumn("__n", n).where(F.col("__n") == 1).drop("__n"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_none(df: DataFrame, what: str) -> None:
    """Hard failure with a few examples if there are any rows."""
    found = df.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def override(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where an override has the key; overrides for unknown keys are an error."""
    require_none(overrides.join(df, key, "left_anti"), "override for an unknown key")
    o = overrides.select(key, F.col(column).alias("__o"))
    return df.join(o, key, "left").withColumn(column, F.coalesce("__o", column)).drop("__o")
