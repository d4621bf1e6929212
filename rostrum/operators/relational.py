"""Filters, work queues, nesting and lookups as DataFrame -> DataFrame functions.

All of them are set-based: a probe per row becomes a semi, anti or left join, an argmax becomes
``max_by`` or a rank whose limit Spark pushes below the exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def title_predicate(title: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Case-insensitive substring match on any of ``include`` and none of ``exclude``; null never matches."""
    low = F.lower(title)
    hit = any_of(*[low.contains(x.lower()) for x in include]) if include else F.lit(True)
    miss = any_of(*[low.contains(x.lower()) for x in exclude]) if exclude else F.lit(False)
    return F.coalesce(hit & ~miss, F.lit(False))


def kind_in(kind: Column, allowed: list, null_ok: bool) -> Column:
    """``kind IN (...)``, with nulls let through where the caller keeps unclassified rows."""
    hit = F.coalesce(kind.isin(allowed), F.lit(False))
    return kind.isNull() | hit if null_ok else hit


def pending(docs: DataFrame, *conditions: Column, done: DataFrame | None = None, on: str = "", limit: int | None = None, order: list[Column] = ()) -> DataFrame:
    """A work queue: rows that meet all conditions and are not in ``done``, newest first, at most ``limit``."""
    out = docs.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))
    if done is not None:
        out = out.join(done.select(on).distinct(), on, "left_anti")
    if order:
        out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def nest(parent: DataFrame, child: DataFrame, key: str, name: str, fields: list[str], order: list[str]) -> DataFrame:
    """Children as an ordered array of structs on each parent; parents without children get ``[]``."""
    grouped = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    out = parent.join(grouped, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(dict(out.dtypes)[name])))


def best_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (give a tie-break)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def collated_places(df: DataFrame, group: list[str], count: str, label: str, language: str, name: str) -> DataFrame:
    """Places from 1 inside a group: larger counts first, equal ones as the language sorts their labels."""
    w = Window.partitionBy(*group).orderBy(F.col(count).desc(), F.collate(label, language), F.col(label))
    return df.withColumn(name, F.row_number().over(w))


def layered_lookup(df: DataFrame, key: str, layers: list[DataFrame], value: str) -> DataFrame:
    """``value`` from the first layer that has ``key``; layers hold unique keys."""
    out, found = df, []
    for i, layer in enumerate(layers):
        name = f"__layer{i}"
        out = out.join(layer.select(key, F.col(value).alias(name)), key, "left")
        found.append(F.col(name))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"__layer{i}" for i in range(len(layers))])


def small_counts(df: DataFrame, key: str, count: str, threshold: int, rest: str) -> DataFrame:
    """Keys counted less than ``threshold`` become one row ``rest``."""
    name = F.when(F.col(count) < threshold, F.lit(rest)).otherwise(F.col(key))
    return df.groupBy(name.alias(key)).agg(F.sum(count).cast("long").alias(count))


def first_seen_ids(df: DataFrame, value: str, seq: str, id_name: str) -> DataFrame:
    """Dictionary ids from 0 in order of first appearance: one row per distinct value."""
    first = df.groupBy(value).agg(F.min(seq).alias("__first"))
    return dense_ids(first, [F.col("__first").asc(), F.col(value).asc()], "__at").withColumn(id_name, F.col("__at").cast("int")).drop("__first", "__at")


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Places from 0 in ``order``, by ranges of it: a range counts its own rows and starts after those before it."""
    ranges = scratch(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    n = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    base = n.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__base"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn("__inside", inside).join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__inside")).drop("__range", "__inside", "__base")


def incremental_cutoff(df: DataFrame, day: Column, by: list[str], overlap_days: int) -> DataFrame:
    """Where the next crawl starts: the newest day per group minus an overlap for late corrections."""
    return df.groupBy(*by).agg(F.date_sub(F.max(day), overlap_days).alias("crawl_from"))


def parent_names(levels: DataFrame) -> DataFrame:
    """level, id, name and the name of the parent one level up (null at the top)."""
    up = levels.select((F.col("level") + 1).alias("level"), F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return levels.join(up, ["level", "parent"], "left").select("level", "id", "name", "parent_name")
