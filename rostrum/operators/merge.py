"""Changes to tables as functions of the old state: the new state is a query, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import dense_ids


def insert_if_absent(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Add rows of ``new`` whose key is not there; of equal keys in ``new`` one row."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def get_or_create(table: DataFrame, wanted: DataFrame, key: list[str], id_name: str) -> DataFrame:
    """Dimension rows for every wanted key, nulls equal; new ids follow the largest in key order."""
    t, w = table.alias("t"), wanted.select(*key).distinct().alias("w")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    new = w.join(t, cond, "left_anti")
    top = table.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("__top"))
    new = dense_ids(new, [F.col(k).asc_nulls_first() for k in key], "__at")
    made = new.crossJoin(F.broadcast(top)).select((F.col("__top") + 1 + F.col("__at")).cast(dict(table.dtypes)[id_name]).alias(id_name), *key)
    return table.select(id_name, *key).unionByName(made)


def merge(old: DataFrame, new: DataFrame, key: list[str], matched: dict[str, Column], unmatched_old: dict[str, Column] | None = None) -> DataFrame:
    """Full outer merge: ``matched`` sets columns from ``o.`` and ``n.`` where both are there,
    ``unmatched_old`` where only the old row is; rows only in ``new`` are added as they are."""
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    cond = None
    for k in key:
        c = F.col(f"o.{k}") == F.col(f"n.{k}")
        cond = c if cond is None else cond & c
    both = o.join(n, cond, "full")
    out = []
    for c in old.columns:
        mine = F.col(f"o.{c}")
        here, there = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
        as_new = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        value = F.when(here & there, matched.get(c, mine)).when(here, (unmatched_old or {}).get(c, mine)).otherwise(as_new)
        out.append(value.alias(c))
    return both.select(*out)


def reseed(old: DataFrame, new: DataFrame, key: list[str], active: str) -> DataFrame:
    """Taxonomy reseed: rows of ``new`` are active with its values, all others stay, inactive. Idempotent."""
    cols = {c: F.col(f"n.{c}") for c in new.columns if c not in key}
    return merge(old, new.withColumn(active, F.lit(True)), key, cols | {active: F.lit(True)}, {active: F.lit(False)})


def backfill(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Fill ``column`` where it is null."""
    v = values.select(key, F.col(column).alias("__v"))
    return table.join(v, key, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v")


def null_out(table: DataFrame, stale: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null the columns of stale rows."""
    out = table.join(stale.select(key).distinct().withColumn("__stale", F.lit(True)), key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__stale").isNull(), F.col(c)))
    return out.drop("__stale")


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Remove parents and the rows that refer to them."""
    g = gone.select(key).distinct()
    return parents.join(g, key, "left_anti"), {n: c.join(g, key, "left_anti") for n, c in children.items()}
