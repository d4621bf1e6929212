"""Similarity of sets, terms and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import cosine


def match_sets(old: DataFrame, new: DataFrame, jaccard: float = 0.6, containment: float = 0.8, least: int = 5) -> DataFrame:
    """Pairs of clusters (c, m: distinct members) that share enough members, by an equality join on members."""
    o, n = old.select(F.col("c").alias("old_c"), "m"), new.select(F.col("c").alias("new_c"), "m")
    both = o.join(n, "m").groupBy("old_c", "new_c").agg(F.count("*").alias("n_both"))
    both = both.join(o.groupBy("old_c").agg(F.count("*").alias("os")), "old_c").join(n.groupBy("new_c").agg(F.count("*").alias("ns")), "new_c")
    j, c = F.col("n_both") / (F.col("os") + F.col("ns") - F.col("n_both")), F.col("n_both") / F.least("os", "ns")
    hit = (j >= jaccard) | ((c >= containment) & (F.col("n_both") >= least))
    return both.where(hit).select("old_c", "new_c", "n_both", F.round(j, 9).alias("jaccard"), F.round(c, 9).alias("containment"))


def top_k_cosine(vectors: DataFrame, query_ids: list[int], k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` most similar rows to each of a stated few rows; the queries are literal, so they are broadcast."""
    q = vectors.where(F.col(id_col).isin(list(query_ids))).select(F.col(id_col).alias("query_id"), F.col(vec).alias("q"))
    pairs = vectors.join(F.broadcast(q), F.col(id_col) != F.col("query_id")).select("query_id", id_col, cosine(F.col(vec), F.col("q")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group, by positions: partial sums, no vectors collected."""
    p = vectors.select(group, F.posexplode(vec).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return p.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def medoids(vectors: DataFrame, group: str, n: int = 3, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``n`` members of each group most similar to its centroid."""
    s = vectors.join(centroids(vectors, group, vec), group).select(group, id_col, F.round(cosine(F.col(vec), F.col("centroid")), 9).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def map_metrics(arguments: DataFrame, sources: DataFrame, source: str, cluster: str) -> DataFrame:
    """cluster, n, median, p90, same_cluster: how far arguments (id, x, y, source) lie from their source (id, x, y) on the map.

    ``same_cluster`` is the share of arguments in their source's cluster; arguments without a source are left out.
    """
    s = sources.select(F.col("id").alias(source), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(cluster).alias("__c"))
    d = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    j = arguments.join(s, source).withColumn("__d", d)
    same = F.avg(F.when(F.col(cluster).eqNullSafe(F.col("__c")), 1.0).otherwise(0.0))
    return j.groupBy(cluster).agg(F.count("*").alias("n"), F.percentile("__d", F.lit(0.5)).alias("median"), F.percentile("__d", F.lit(0.9)).alias("p90"), same.alias("same_cluster"))
