"""Term statistics on (id, term) rows: tf-idf, contrast, dispersion, cluster terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .relational import best_per_group


def _by_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts dealt out by ``key``: their tokens are many times longer, and counting them per key then moves nothing."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition("id")


def tokens(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """One row per token of at least ``least`` letters, lower case."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{%d,}" % least), F.lit(0))
    return _by_key(df, key, text).select("id", F.explode(w).alias("term"))


def _idf(n: int, df: str = "df"):
    return F.ln((1.0 + F.lit(n)) / (1 + F.col(df))) + 1


def tfidf(toks: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, key: str = "doc_id") -> DataFrame:
    """key, term, weight: smooth idf, rows of length one; terms in few or in most documents left out."""
    tf = toks.groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    w = tf.join(df, "term").select("id", "term", (F.col("tf") * _idf(n_docs)).alias("w"))
    w = w.withColumn("l", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))
    return w.select(F.col("id").alias(key), "term", (F.col("w") / F.col("l")).alias("weight"))


def contrast(toks: DataFrame, sides: DataFrame, min_df: int) -> DataFrame:
    """term, contrast: share of documents inside minus share of all documents with the term."""
    n = sides.agg(F.count(F.when(F.col("inside"), 1)).alias("na"), F.count("*").alias("nb"))
    t = toks.distinct().join(sides.withColumnRenamed("doc_id", "id"), "id")
    c = t.groupBy("term").agg(F.count(F.when(F.col("inside"), 1)).alias("a"), F.count("*").alias("b")).where(F.col("b") >= min_df)
    return c.crossJoin(F.broadcast(n)).select("term", F.round(F.col("a") / F.col("na") - F.col("b") / F.col("nb"), 9).alias("contrast"))  # one row of totals


def contrast_weights(weights: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """child, term, contrast: the ``n`` terms whose mean weight in a child is most above that in its parent.

    ``weights``: doc_id, term, weight; ``members``: doc_id, child, parent (each child in one parent; rows without either take no part).
    Documents without a term count with weight 0; ties go to the lesser term, and contrasts of 0 or less are left out.
    """
    m = members.where("child IS NOT NULL AND parent IS NOT NULL")
    sizes = m.groupBy("parent", "child").agg(F.count("*").alias("own"))
    sizes = sizes.join(sizes.groupBy("parent").agg(F.sum("own").alias("all")), "parent")
    # One partial sum for each child and term; the parents' sums are over those.
    c = weights.join(m, "doc_id").groupBy("parent", "child", "term").agg(F.sum("weight").alias("w"))
    p = c.groupBy("parent", "term").agg(F.sum("w").alias("pw"))
    both = c.join(p, ["parent", "term"]).join(sizes, ["parent", "child"])
    d = both.select("child", "term", F.round(F.col("w") / F.col("own") - F.col("pw") / F.col("all"), 9).alias("contrast")).where("contrast > 0")
    return best_per_group(d, ["child"], [F.desc("contrast"), F.col("term")], n)


def diffuse(toks: DataFrame, points: DataFrame, min_df: int, most: float) -> DataFrame:
    """Terms whose documents lie scattered: spread of their points over the spread of all."""
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    all_points = points.agg(spread.alias("s"))
    p = toks.distinct().join(points.withColumnRenamed("doc_id", "id"), "id").groupBy("term").agg(F.count("*").alias("df"), spread.alias("d"))
    r = F.col("d") / F.col("s")
    return p.where(F.col("df") >= min_df).crossJoin(F.broadcast(all_points)).where(r > most).select("term", "df", F.round(r, 7).alias("dispersion"))  # one row


def cluster_terms(toks: DataFrame, members: DataFrame, n: int, min_df: int = 2) -> DataFrame:
    """Ranked terms per cluster: precision x coverage x contrast of documents with the term."""
    t = toks.distinct().join(members.withColumnRenamed("doc_id", "id"), "id")
    total = members.count()
    c = t.groupBy("cluster", "term").agg(F.count("*").alias("inside"))
    d = t.groupBy("term").agg(F.count("*").alias("df"))
    s = members.groupBy("cluster").agg(F.count("*").alias("size"))
    c = c.where(F.col("inside") >= min_df).join(d, "term").join(s, "cluster")
    coverage, precision = F.col("inside") / F.col("size"), F.col("inside") / F.col("df")
    score = precision * coverage * (coverage / (F.col("df") / F.lit(total)))
    return best_per_group(c.select("cluster", "term", "inside", F.round(score, 9).alias("score")), ["cluster"], [F.desc("score"), F.col("term")], n)


def with_pairs(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """One row per token of at least ``least`` letters and per pair of neighbouring tokens."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{%d,}" % least), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    terms = F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))
    return _by_key(df, key, text).select("id", w.alias("w")).select("id", F.explode(terms).alias("term"))


def representatives(members: DataFrame, hulls: DataFrame, near: int = 5) -> DataFrame:
    """cluster, doc_id: the documents nearest to their cluster's centroid and those on the corners of its hull.

    ``members``: doc_id, cluster, x, y; ``hulls``: cluster, cx, cy, xs, ys with corners that are members' places (of equal places the
    least doc_id stands for the corner).
    """
    m = members.join(hulls.select("cluster", "cx", "cy"), "cluster")
    d = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    middle = best_per_group(m.withColumn("__d", d), ["cluster"], [F.col("__d"), F.col("doc_id")], near).select("cluster", "doc_id")
    corners = hulls.where(F.size("xs") >= 3).select("cluster", F.inline(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))))
    edge = members.join(corners, ["cluster", "x", "y"]).groupBy("cluster", "x", "y").agg(F.min("doc_id").alias("doc_id")).select("cluster", "doc_id")
    return middle.unionByName(edge).distinct()


def hull_anchored_terms(toks: DataFrame, members: DataFrame, hulls: DataFrame, n: int, base: DataFrame | None = None) -> DataFrame:
    """cluster, term, inside, score: the ``n`` best terms of each cluster on a map.

    The score is compactness (1 - the term's spread over that of all documents, 0.01 at least) x precision x coverage x contrast
    (``base``: cluster, term, weight, 0.1 at least; 1 without) x (1 + 2 x its share of the representatives).  A term needs 2 documents of
    the cluster, or from 25 documents on 2 % and 3 at least, and one representative; where a cluster has no such term the representative is not
    asked for, and then 2 documents are enough.  ``toks``: id, term; ``members``: doc_id, cluster, x, y; only their documents count.
    """
    spread_of = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    chosen = scratch(representatives(members, hulls), "representatives")
    own = members.join(chosen.withColumn("rep", F.lit(1)), ["cluster", "doc_id"], "left").withColumnRenamed("doc_id", "id")
    t = toks.join(own.select("id").distinct(), "id", "left_semi").distinct().join(own, "id")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size")).join(chosen.groupBy("cluster").agg(F.count("*").alias("reps")), "cluster")
    every = members.agg(spread_of.alias("all_spread"))
    c = t.groupBy("cluster", "term").agg(F.count("*").alias("inside"), F.count("rep").alias("rep_df"))
    g = t.groupBy("term").agg(F.count("*").alias("df"), spread_of.alias("spread"))
    j = c.where("inside >= 2").join(g, "term").join(sizes, "cluster").crossJoin(F.broadcast(every))  # one row
    least = F.when(F.col("size") < 25, 2).otherwise(F.greatest(F.lit(3), F.floor(F.col("size") * 0.02)))
    rung = F.when((F.col("inside") >= least) & (F.col("rep_df") >= 1), 0).when(F.col("inside") >= least, 1).otherwise(2)
    # Terms of a cluster are many, so the best rung is an aggregate and not a window over them.
    j = j.withColumn("rung", rung)
    j = j.join(j.groupBy("cluster").agg(F.min("rung").alias("rung")), ["cluster", "rung"])
    compact = F.greatest(F.lit(0.01), 1 - F.coalesce(F.try_divide("spread", "all_spread"), F.lit(1.0)))
    boost = F.lit(1.0)
    if base is not None:
        j = j.join(base.select("cluster", "term", F.col("weight").alias("__w")), ["cluster", "term"], "left")
        boost = F.greatest(F.lit(0.1), F.coalesce("__w", F.lit(0.0)))
    score = compact * (F.col("inside") / F.col("df")) * (F.col("inside") / F.col("size")) * boost * (1 + 2 * F.col("rep_df") / F.col("reps"))
    return best_per_group(j.select("cluster", "term", "inside", F.round(score, 9).alias("score")), ["cluster"], [F.desc("score"), F.col("term")], n)
