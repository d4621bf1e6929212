"""Connected components by alternating large-star and small-star steps on edges (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node u points itself (small) or its larger neighbours (large) to its least neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where(F.col("v") > F.col("u")).select("v", "m")
    else:
        out = out.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has an edge.

    ``edges`` has longs u and v; loops and repeated edges are allowed.  Each round is written to the
    shared folder; rounds grow with the logarithm of the largest component, not with its size.
    """
    cur = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(limit):
        got = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            break
        mark = got
        new = scratch(_star(_star(cur, True), False), "edges")
        drop_scratch(cur)
        cur = new
    else:
        raise RuntimeError("components did not settle")
    own = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
