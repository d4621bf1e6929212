"""Projections, levels of clusters and grids over vectors.

Density clustering and manifold projection of the reference have no Spark counterpart; PCA and
bisecting k-means stand in for them (see README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import cosine, lab_to_rgb
from ..session import scratch
from . import spatial


def _features(df: DataFrame, key: str, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))


def pca(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """key, x0, x1, ..: principal coordinates; an axis' largest loading is positive."""
    from pyspark.ml.feature import PCA

    f = _features(df, key, vec)
    m = PCA(k=k, inputCol="features").fit(f).pc.toArray()
    m = m * np.sign(m[np.abs(m).argmax(axis=0), np.arange(k)])
    v = F.col(vec).cast("array<double>")
    axis = lambda j: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in m[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.select(key, *[axis(j).alias(f"x{j}") for j in range(k)])


def levels(df: DataFrame, key: str, vec: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """key and one cluster id per level, every row in exactly one cluster of each level."""
    from pyspark.ml.clustering import BisectingKMeans

    f = _features(df, key, vec)
    out = df.select(key)
    for i, k in enumerate(sizes):
        got = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"level{i}").fit(f).transform(f)
        out = out.join(got.select(key, f"level{i}"), key)
    return out


#: Clusters on each side of a tile in which clusters look for their nearest.
TILE = 8192


def linkage(df: DataFrame, group: str, key: str, vec: str, cut: float, block: int = 4000) -> DataFrame:
    """Average-linkage clusters by cosine distance <= ``cut`` within each group: group, key, cluster (its least key).

    The average distance of two clusters of unit vectors follows from their sums and sizes, and average
    linkage gives one result in whatever order mutually nearest clusters merge.  So groups of up to ``block``
    rows are merged in one task, and larger ones in rounds: clusters look for their nearest, tile
    against tile, and all mutual pairs merge.  Both give the same clusters.
    """
    d = df.select(group, F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("s"))
    norm = F.greatest(F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    d = d.withColumn("s", F.transform("s", lambda x: x / norm))
    sizes = scratch(df.groupBy(group).agg(F.count("*").alias("rows")), "linkage-sizes")
    large = F.col("rows") > block
    d = d.join(sizes, d[group].eqNullSafe(sizes[group])).select(d[group], "id", "s", large.alias("large"))
    kinds = dict(df.dtypes)
    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, cluster {kinds[key]}"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        label = _merged(np.stack(g.s.to_numpy()), np.ones(len(g)), cut)
        return pd.DataFrame({group: g[group], key: g["id"], "cluster": g["id"].to_numpy()[label]})

    small = d.where("not large").groupBy(group).applyInPandas(run, schema)
    if sizes.where(large).isEmpty():
        return small
    return small.unionByName(_linkage_rounds(d.where("large").select(group, "id", "s"), group, cut, block).withColumnRenamed("id", key))


def _merged(v: np.ndarray, size: np.ndarray, cut: float) -> np.ndarray:
    """For each cluster (mean of its unit vectors, size) the first one of those it ends up with."""
    dist = v @ v.T
    np.subtract(1, dist, out=dist)
    np.fill_diagonal(dist, np.inf)
    size, label = size.astype(float), np.arange(len(v))
    # Every row's nearest is kept; after a merge only rows whose nearest took part look again.
    at = dist.argmin(axis=1)
    near = dist[label, at]
    while True:
        i = int(near.argmin())
        j = int(at[i])
        if not near[i] <= cut:
            return label
        i, j = min(i, j), max(i, j)
        row = (dist[i] * size[i] + dist[j] * size[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = row, row
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        nearer = (row < near) | ((row == near) & (at > i))
        lost = (at == i) | (at == j)
        lost[i] = True
        near[nearer], at[nearer] = row[nearer], i
        again = np.flatnonzero(lost & np.isfinite(near))
        at[again] = dist[again].argmin(axis=1)
        near[again] = dist[again, at[again]]
        near[j] = np.inf


def _nearest(askers: DataFrame, others: DataFrame, group: str, cut: float) -> DataFrame:
    """group, id, d, other: each asker's nearest cluster within ``cut`` (ties: smaller id); no row without one."""
    kinds = dict(askers.dtypes)

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {group: [], "id": [], "d": [], "other": []}
        if len(a) and len(b):
            b = b.sort_values("id")
            ids, own = b["id"].to_numpy(), a["id"].to_numpy()
            va, vb = (np.stack(x.s.to_numpy()) / x.n.to_numpy()[:, None] for x in (a, b))
            place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            for at in range(0, len(a), 512):
                part = slice(at, at + 512)
                dist = va[part] @ vb.T
                np.subtract(1, dist, out=dist)
                mine = np.flatnonzero(ids[place[part]] == own[part])
                dist[mine, place[part][mine]] = np.inf
                rows = np.flatnonzero(dist.min(axis=1) <= cut + 1e-9)
                # Rounded, so that both sides of a pair see one distance.
                dist = np.round(dist[rows], 12)
                j = dist.argmin(axis=1)
                d = dist[np.arange(len(rows)), j]
                hit = d <= cut
                rows, j, d = rows[hit] + at, j[hit], d[hit]
                for c, x in zip(out, (a[group].to_numpy()[rows], own[rows], d, ids[j]), strict=True):
                    out[c].extend(x)
        return pd.DataFrame(out)

    most = [df.groupBy(group).count().agg(F.max("count")).first()[0] or 1 for df in (askers, others)]
    n, m = (-(-x // TILE) for x in most)
    mine = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = askers.withColumn("a", mine(n)).withColumn("b", every(m))
    right = others.withColumn("b", mine(m)).withColumn("a", every(n))
    found = left.groupBy(group, "a", "b").cogroup(right.groupBy(group, "a", "b")).applyInPandas(look, f"{group} {kinds[group]}, id {kinds['id']}, d double, other {kinds['id']}")
    return found.groupBy(group, "id").agg(F.min(F.struct("d", "other")).alias("m")).select(group, "id", "m.d", "m.other")


def _linkage_rounds(d: DataFrame, group: str, cut: float, block: int) -> DataFrame:
    """Merge in rounds until a group has so few clusters left that can merge that one task does the rest.

    Two clusters are never nearer once merged with others than the nearer of their parts was.  So a cluster without another
    within ``cut`` is done for good, and one whose nearest did not merge keeps it.  Copies are merged before the first round.
    """
    kinds = dict(d.dtypes)
    # Vectors of length zero are at distance 1 from each other too.
    d = d.withColumn("zero", F.when(F.exists("s", lambda x: x != 0), None).otherwise(F.col("id")))
    once = scratch(d.groupBy(group, "s", "zero").agg(F.min("id").alias("id"), F.count("*").alias("n")), "linkage")
    first = once.select(F.col(group).alias("g"), F.col("s").alias("v"), F.col("zero").alias("z"), F.col("id").alias("cluster"))
    members = d.join(first, d[group].eqNullSafe(F.col("g")) & (F.col("s") == F.col("v")) & F.col("zero").eqNullSafe(F.col("z")))
    members = scratch(members.select(group, "id", "cluster"), "linkage")
    cur = once.select(group, "id", F.transform("s", lambda x: x * F.col("n")).alias("s"), "n")
    best = scratch(_nearest(cur, cur, group, cut), "linkage")

    def rest(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        n = g.n.to_numpy()
        label = _merged(np.stack(g.s.to_numpy()) / n[:, None], n, cut)
        return pd.DataFrame({"g": g[group], "to": g["id"].to_numpy()[label], "gone": g["id"]})

    def renamed(members: DataFrame, merges: DataFrame) -> DataFrame:
        m = members.join(merges, members[group].eqNullSafe(merges["g"]) & (members["cluster"] == merges["gone"]), "left")
        return scratch(m.select(members[group], "id", F.coalesce("to", "cluster").alias("cluster")), "linkage")

    while not best.isEmpty():
        cur = cur.join(best.select(F.col(group).alias("g"), F.col("id").alias("i")), cur[group].eqNullSafe(F.col("g")) & (cur["id"] == F.col("i")), "left_semi")
        left = scratch(cur.groupBy(F.col(group).alias("g")).agg((F.count("*") <= block).alias("few")), "linkage")
        few, many = left.where("few"), left.where("not few")
        of = lambda df, some: df.join(some, df[group].eqNullSafe(some["g"]), "left_semi")
        last = of(cur, few).groupBy(group).applyInPandas(rest, f"g {kinds[group]}, to {kinds['id']}, gone {kinds['id']}").where("to <> gone")
        if many.isEmpty():
            return renamed(members, last)
        best = scratch(of(best, many), "linkage")
        x, y = best.alias("x"), best.alias("y")
        mutual = F.col(f"x.{group}").eqNullSafe(F.col(f"y.{group}")) & (F.col("x.other") == F.col("y.id")) & (F.col("y.other") == F.col("x.id"))
        pairs = x.join(y, mutual).where("x.id < x.other").select(F.col(f"x.{group}").alias("g"), F.col("x.id").alias("to"), F.col("x.other").alias("gone"))
        merges = scratch(pairs, "linkage")
        if merges.isEmpty():  # ties in a ring: the least pair of each group
            least = best.groupBy(F.col(group).alias("g")).agg(F.min(F.struct("d", F.least("id", "other").alias("to"), F.greatest("id", "other").alias("gone"))).alias("m"))
            merges = scratch(least.select("g", "m.to", "m.gone"), "linkage")
        cur = of(cur, many)
        joined = cur.join(merges, cur[group].eqNullSafe(merges["g"]) & (cur["id"] == merges["gone"]), "left")
        sums = F.reduce(F.collect_list("s"), F.transform(F.first("s"), lambda e: e * 0), lambda t, v: F.zip_with(t, v, lambda p, q: p + q))
        cur = scratch(joined.groupBy(cur[group], F.coalesce("to", "id").alias("id")).agg(sums.alias("s"), F.sum("n").alias("n")), "linkage")
        members = renamed(members, merges.unionByName(last))
        moved = scratch(merges.select("g", F.explode(F.array("to", "gone")).alias("i")), "linkage")
        hit = lambda c: best[group].eqNullSafe(moved["g"]) & (best[c] == moved["i"])
        kept = best.join(moved, hit("id"), "left_anti").join(moved, hit("other"), "left_anti")
        ask = scratch(cur.join(kept.select(F.col(group).alias("g"), F.col("id").alias("i")), cur[group].eqNullSafe(F.col("g")) & (cur["id"] == F.col("i")), "left_anti"), "linkage")
        best = scratch(kept.unionByName(_nearest(ask, cur, group, cut)), "linkage")
    return members


def pair_similarity(df: DataFrame, cluster: str, key: str, vec: str) -> DataFrame:
    """cluster, n, similarity, baseline: do members of a cluster resemble each other more than rows at random?

    ``similarity``: mean cosine of the members to their cluster's first one (by key; itself left out, null for clusters of one);
    ``baseline``: that of the members to a shuffled partner, the next row in the order of a hash, in rings of a 256th of all rows.
    """
    first = df.groupBy(F.col(cluster).alias("__c")).agg(F.min_by(vec, key).alias("__v"), F.min(key).alias("__k"))
    near = df.join(first, F.col(cluster).eqNullSafe(F.col("__c"))).where(F.col(key) != F.col("__k"))
    inner = near.groupBy("__c").agg(F.avg(cosine(F.col(vec), F.col("__v"))).alias("similarity"))
    h = F.md5(F.col(key).cast("string"))
    ring = Window.partitionBy(F.substr(h, F.lit(1), F.lit(2))).orderBy(h, key)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = F.coalesce(F.lead(vec).over(ring), F.first(vec).over(whole))
    outer = df.withColumn("__p", partner).groupBy(cluster).agg(F.count("*").alias("n"), F.avg(cosine(F.col(vec), F.col("__p"))).alias("baseline"))
    return outer.join(inner, F.col(cluster).eqNullSafe(F.col("__c")), "left").select(cluster, "n", "similarity", "baseline")


def semantic_grid(points: DataFrame, cell: float, radius: float, k: int) -> DataFrame:
    """Per cell with enough near points: the dominant label by Gaussian weight of its ``k`` nearest points."""
    centres = spatial.cells(points, cell).select(F.concat_ws("/", "ix", "iy").alias("id"), ((F.col("ix") + 0.5) * cell).alias("x"), ((F.col("iy") + 0.5) * cell).alias("y"))
    near = spatial.k_nearest(centres, points.select("id", "x", "y"), radius, k).join(points.select("id", "label"), "id")
    w = near.groupBy("query_id", "label").agg(F.sum(F.exp(-F.pow(F.col("distance") / (radius / 2), 2))).alias("w"), F.count("*").alias("c"), F.min("distance").alias("first"))
    g = w.groupBy("query_id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"), F.sum("c").alias("points"), F.min("first").alias("nearest"))
    return g.where("points >= 4 AND nearest <= 0.8").select(F.col("query_id").alias("cell"), "label", "points")


def colour_raster(vectors: DataFrame, cell: float) -> DataFrame:
    """Cells of the first two principal axes coloured by the mean of the next three (clipped to p5..p95)."""
    p = pca(vectors, "vec_id", "embedding", 5)
    g = p.groupBy(F.floor(F.col("x0") / cell).alias("ix"), F.floor(F.col("x1") / cell).alias("iy")).agg(*[F.avg(f"x{j}").alias(f"c{j}") for j in (2, 3, 4)], F.count("*").alias("n"))
    lim = p.agg(*[F.percentile_approx(f"x{j}", q, 10000).alias(f"{n}{j}") for j in (2, 3, 4) for n, q in (("lo", 0.05), ("hi", 0.95))])
    unit = lambda j: F.least(F.greatest((F.col(f"c{j}") - F.col(f"lo{j}")) / (F.col(f"hi{j}") - F.col(f"lo{j}")), F.lit(0.0)), F.lit(1.0))
    r, gr, b = lab_to_rgb(30 + 60 * unit(2), 120 * unit(3) - 60, 120 * unit(4) - 60)
    return g.crossJoin(F.broadcast(lim)).select("ix", "iy", "n", r.alias("r"), gr.alias("g"), b.alias("b"))  # one row of limits
