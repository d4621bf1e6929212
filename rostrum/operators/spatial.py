"""Point clouds as cells, tiles and clusters.

Grids are joined on cell keys; neighbourhoods are joined on a handful of offsets, so no step
compares all points with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import tile, uniform_from_id
from ..session import scratch
from .relational import dense_ids


def cells(points: DataFrame, size: float, by: list[str] = ()) -> DataFrame:
    """ix, iy, n: points per square cell."""
    ix, iy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    return points.groupBy(*by, ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"))


def blur(grid: DataFrame, sigma: float, by: list[str] = ()) -> DataFrame:
    """Gaussian smoothing of ``n`` over cells as two passes of an offset table (separable kernel)."""
    reach = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(v / sum(w)).alias("w")) for d, v in zip(range(-reach, reach + 1), w, strict=True)])

    def one(df, axis):
        k = df.select(*by, "ix", "iy", "n", F.explode(kernel).alias("k"))
        moved = k.withColumn(axis, F.col(axis) + F.col("k.d"))
        return moved.groupBy(*by, "ix", "iy").agg(F.sum(F.col("n") * F.col("k.w")).alias("n"))

    return one(one(grid, "ix"), "iy")


def density(points: DataFrame, size: float, sigma: float, gamma: float = 0.5) -> DataFrame:
    """ix, iy, value in 0..1: smoothed counts over their maximum, to a power."""
    g = blur(cells(points, size), sigma)
    top = g.agg(F.max("n").alias("top"))
    return g.crossJoin(F.broadcast(top)).select("ix", "iy", F.pow(F.col("n") / F.col("top"), gamma).alias("value"))  # one row


def sample(points: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """Bilinear value of a grid (at cell centres) at each point (id, x, y)."""
    fx, fy = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    corners = F.array(*[
        F.struct((F.floor(fx) + a).alias("ix"), (F.floor(fy) + b).alias("iy"), ((fx - F.floor(fx) if a else 1 - fx + F.floor(fx)) * (fy - F.floor(fy) if b else 1 - fy + F.floor(fy))).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ])
    c = points.select("id", F.inline(corners))
    return c.join(grid, ["ix", "iy"], "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def relative_density(points: DataFrame, group: Column, size: float, sigma: float, levels=(1.5, 3.0), floor: float = 0.02) -> DataFrame:
    """Cells where a group's share is ``level`` times its overall share, outside nearly empty ones: level index per cell."""
    p = points.withColumn("inside", group.cast("int"))
    total = blur(cells(p, size), sigma)
    part = blur(cells(p.where("inside = 1"), size), sigma).withColumnRenamed("n", "g")
    share = p.agg(F.avg("inside").alias("share"))
    top = total.agg(F.max("n").alias("top"))
    t = total.crossJoin(F.broadcast(top)).where(F.col("n") >= floor * F.col("top"))  # one row
    r = t.join(part, ["ix", "iy"]).crossJoin(F.broadcast(share)).withColumn("ratio", F.col("g") / F.col("n") / F.col("share"))  # one row
    lev = sum(F.when(F.col("ratio") >= x, 1).otherwise(0) for x in levels)
    return r.select("ix", "iy", F.round("ratio", 7).alias("ratio"), lev.alias("level")).where("level > 0")


def ranked(points: DataFrame, weight: Column, buckets: int = 256) -> DataFrame:
    """Global rank by sampling key -ln(U)/w without a single-partition window.

    Keys fall into buckets of their order; counts per bucket give each bucket's first rank.
    """
    u = uniform_from_id(F.col("id"))
    key = -F.ln(u) / weight
    p = points.withColumn("key", key)
    b = p.withColumn("b", F.floor((1 - F.exp(-F.col("key"))) * buckets))
    n = b.groupBy("b").agg(F.count("*").alias("n"))
    base = n.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("key", "id"))
    return b.join(base, "b").withColumn("rank", (F.col("base") + inside).cast("long")).drop("b", "base")


def thin(points: DataFrame, zooms: list[int], per_tile: int, lo: float, hi: float, weight: Column) -> DataFrame:
    """Points shown per zoom: those ranked below tiles x ``per_tile``; what one zoom shows, all later ones do."""
    r = ranked(points, weight)
    z = r.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    tx, ty = tile(F.col("x"), F.col("y"), F.col("z"), lo, hi)
    z = z.withColumn("tx", tx).withColumn("ty", ty)
    budget = z.select("z", "tx", "ty").distinct().groupBy("z").agg((F.count("*") * per_tile).alias("budget"))
    # Monotone: a later zoom never has a smaller budget.
    budget = budget.withColumn("budget", F.max("budget").over(Window.orderBy("z")))
    return z.join(F.broadcast(budget), "z").where(F.col("rank") <= F.col("budget")).select("z", "tx", "ty", "id", "x", "y", "rank")  # one row per zoom


def survivors(shown: DataFrame, points: DataFrame, zoom: int, lo: float, hi: float) -> DataFrame:
    """Every point counted at its nearest shown point of the zoom (ties: the smaller id).

    Looked for in a point's own and adjacent tiles; where the nearest found lies beyond a tile's width, or none
    was found, again in tiles twice as wide, and at last among all.
    """
    s = shown.where(F.col("z") == zoom).select(F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    left, settled = points.select("id", "x", "y"), []
    d = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    for level in range(zoom, -2, -1):
        width = (hi - lo) / 2.0**level
        place = lambda v: F.floor((F.col(v) - lo) / width) if level >= 0 else F.lit(0).cast("long")  # noqa: E731, B023
        p = left.withColumn("o", F.explode(offs if level >= 0 else F.array(offs[4])))
        p = p.select("id", "x", "y", (place("x") + F.col("o.a")).alias("tx"), (place("y") + F.col("o.b")).alias("ty"))
        near = p.join(s.select("*", place("sx").alias("tx"), place("sy").alias("ty")), ["tx", "ty"]).groupBy("id").agg(F.min(F.struct(d.alias("d"), "sid")).alias("m"))
        if level < 0:
            settled.append(near)
            break
        near = scratch(left.join(near.where(F.col("m.d") <= width * width), "id", "left"), "survivors")
        settled.append(near.where("m is not null").select("id", "m"))
        left = near.where("m is null").select("id", "x", "y")
        if left.isEmpty():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found.groupBy(F.col("m.sid").alias("id")).agg(F.count("*").alias("point_count"))


def k_nearest(queries: DataFrame, points: DataFrame, radius: float, k: int, digits: int | None = None) -> DataFrame:
    """Up to ``k`` points within ``radius`` of each query, nearest first, then by id; with ``digits``, distances are rounded first.

    Cells are halved from the width of the radius down to a few points each.  A query looks around itself in the finest cells of
    which the nine about it hold ``k`` points: then the k-th nearest is within three of those cells.  So the pairs grow with the
    queries, however many points lie within the radius.  Queries on one place look once, and of points on one place ``k`` suffice.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    own = Window.partitionBy("x", "y").orderBy("id")
    few = scratch(points.where(finite).select("id", "x", "y").withColumn("own", F.row_number().over(own)).where(F.col("own") <= k).drop("own"), "points")
    asked = scratch(queries.where(finite).select(F.col("x").alias("qx"), F.col("y").alias("qy")).distinct(), "asked")
    finest = max(2, math.ceil(math.log2(max(few.count(), 1)) / 2) + 2)

    def filed(df: DataFrame, x: str, y: str) -> DataFrame:
        """A row for each width of cells; a half of the radius is left out, where nine cells of the radius are fewer."""
        at = df.withColumn("level", F.explode(F.array(F.lit(0), *map(F.lit, range(2, finest + 1)))))
        cell = lambda c: F.floor(F.col(c) / radius * F.pow(F.lit(2.0), F.col("level")))
        return at.withColumn("cx", cell(x)).withColumn("cy", cell(y))

    def around(df: DataFrame, reach: Column) -> DataFrame:
        side = lambda n: F.explode(F.sequence(-reach, reach)).alias(n)
        return df.select("*", side("a")).select("*", side("b")).withColumn("cx", F.col("cx") + F.col("a")).withColumn("cy", F.col("cy") + F.col("b")).drop("a", "b")

    cells_, counts = filed(asked, "qx", "qy"), filed(few, "x", "y").groupBy("level", "cx", "cy").agg(F.count("*").alias("n"))
    near = around(cells_.where("level > 0").select("level", "cx", "cy", F.col("cx").alias("ox"), F.col("cy").alias("oy")).distinct(), F.lit(1))
    full = near.join(counts, ["level", "cx", "cy"]).groupBy("level", F.col("ox").alias("cx"), F.col("oy").alias("cy")).agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    level = cells_.join(full, ["level", "cx", "cy"], "left").groupBy("qx", "qy").agg(F.max(F.when(F.col("n").isNotNull(), F.col("level")).otherwise(0)).alias("level"))
    size = F.pow(F.lit(2.0), F.col("level"))
    q = level.select("qx", "qy", "level", F.floor(F.col("qx") / radius * size).alias("cx"), F.floor(F.col("qy") / radius * size).alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2))
    reach = F.when(F.col("level") > 0, 3).otherwise(1)
    hit = around(q, reach).join(filed(few, "x", "y"), ["level", "cx", "cy"]).withColumn("distance", d if digits is None else F.round(d, digits))
    w = Window.partitionBy("qx", "qy").orderBy("distance", "id")
    best = hit.where(F.col("distance") < radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qx", "qy", "id", "distance", "rank")
    back = queries.select(F.col("id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return back.join(best, ["qx", "qy"]).select("query_id", "id", "distance", "rank")


def grid_clusters(points: DataFrame, size: float, least: int) -> DataFrame:
    """Density clusters: dense cells joined over their edges and corners; id, cluster (-1: noise).

    Cells, not points, form the graph, whose components are found by label propagation.
    """
    c = points.withColumn("ix", F.floor(F.col("x") / size)).withColumn("iy", F.floor(F.col("y") / size))
    dense = c.groupBy("ix", "iy").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("ix", "iy", F.struct("ix", "iy").alias("label"))
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    dense = scratch(dense, "cells")
    while True:
        moved = dense.withColumn("o", F.explode(offs)).select((F.col("ix") + F.col("o.a")).alias("ix"), (F.col("iy") + F.col("o.b")).alias("iy"), F.col("label").alias("l"))
        new = scratch(dense.join(moved, ["ix", "iy"]).groupBy("ix", "iy").agg(F.min("l").alias("label")), "cells")
        changed = new.join(dense.withColumnRenamed("label", "old"), ["ix", "iy"]).where("label <> old").isEmpty()
        dense = new
        if changed:
            break
    ids = dense_ids(dense.select("label").distinct(), [F.col("label")], "cluster").select("label", F.col("cluster").cast("int"))
    return c.join(dense.join(ids, "label").select("ix", "iy", "cluster"), ["ix", "iy"], "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _chain(pts: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the lowest x (Andrew's monotone chain)."""
    p = np.unique(pts, axis=0)
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(points: DataFrame, group: str, keep: float = 0.92) -> DataFrame:
    """Centroid and convex hull per group after dropping the farthest points.

    Tasks reduce their share of a group to its own hull first; the hull of those few corners is the
    hull of the group, so a group of any size stays small where it meets.
    """
    c = points.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    d = points.join(c, group).withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)))
    cut = d.groupBy(group).agg(F.percentile_approx("d", keep, 10000).alias("cut"))
    near = d.join(cut, group).where("d <= cut").select(group, "cx", "cy", "n", "x", "y")

    def corners(batches):
        for b in batches:
            parts = [g.iloc[:0] if not len(g) else pd.DataFrame({group: k[0], "cx": k[1], "cy": k[2], "n": k[3], "x": h[:, 0], "y": h[:, 1]}) for k, g in b.groupby([group, "cx", "cy", "n"]) for h in [_chain(g[["x", "y"]].to_numpy())]]
            if parts:
                yield pd.concat(parts)

    kind = dict(points.dtypes)[group]
    few = near.mapInPandas(corners, near.schema)

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        h = _chain(g[["x", "y"]].to_numpy())
        return pd.DataFrame({group: [g[group].iloc[0]], "cx": [g.cx.iloc[0]], "cy": [g.cy.iloc[0]], "n": [g.n.iloc[0]], "xs": [h[:, 0].tolist()], "ys": [h[:, 1].tolist()]})

    return few.groupBy(group).applyInPandas(whole, f"{group} {kind}, cx double, cy double, n long, xs array<double>, ys array<double>")


def contains(px: float, py: float, xs, ys) -> bool:
    """Whether a polygon holds a point (edges count as inside for the lower and left ones)."""
    inside, j = False, len(xs) - 1
    for i in range(len(xs)):
        if (ys[i] > py) != (ys[j] > py) and px < (xs[j] - xs[i]) * (py - ys[i]) / (ys[j] - ys[i]) + xs[i]:
            inside = not inside
        j = i
    return inside


def clip_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two convex counter-clockwise polygons."""
    out = [tuple(p) for p in a]
    for i in range(len(b)):
        p, q = b[i], b[(i + 1) % len(b)]
        side = lambda r, p=p, q=q: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        new = []
        for j in range(len(out)):
            r, s = out[j], out[(j + 1) % len(out)]
            sr, ss = side(r), side(s)
            if sr >= 0:
                new.append(r)
            if sr * ss < 0:
                t = sr / (sr - ss)
                new.append((r[0] + t * (s[0] - r[0]), r[1] + t * (s[1] - r[1])))
        out = new
        if not out:
            return 0.0
    x, y = np.array(out).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def hull_pairs(h: DataFrame, group: str, size: float) -> DataFrame:
    """Pairs of hulls whose boxes share a cell of ``size``: overlap area, intersection over union."""
    box = [F.floor(f(c) / size) for c in ("xs", "ys") for f in (F.array_min, F.array_max)]
    b = h.select(F.col(group).alias("g"), "xs", "ys", F.explode(F.sequence(box[0], box[1])).alias("bx"), *[x.alias(n) for x, n in zip(box[2:], ("lo", "hi"), strict=True)]).withColumn("by", F.explode(F.sequence("lo", "hi")))
    a = b.select(F.col("g").alias("a"), F.col("xs").alias("ax"), F.col("ys").alias("ay"), "bx", "by")
    p = a.join(b.select(F.col("g").alias("b"), "xs", "ys", "bx", "by"), ["bx", "by"]).where("a < b").dropDuplicates(["a", "b"])

    @F.pandas_udf("double")
    def overlap(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([clip_area(np.c_[a, b], np.c_[c, d]) if min(len(a), len(c)) > 2 else 0.0 for a, b, c, d in zip(ax, ay, bx, by, strict=True)], dtype=float)

    from ..functions.maths import polygon_area

    p = p.select("a", "b", overlap("ax", "ay", "xs", "ys").alias("overlap"), F.abs(polygon_area(F.col("ax"), F.col("ay"))).alias("area_a"), F.abs(polygon_area(F.col("xs"), F.col("ys"))).alias("area_b"))
    return p.withColumn("iou", F.coalesce(F.try_divide("overlap", F.col("area_a") + F.col("area_b") - F.col("overlap")), F.lit(0.0)))


def smooth_ring(ring: np.ndarray, samples: int = 60) -> np.ndarray:
    """``samples`` points of the closed cubic spline through the corners of ``ring`` (n x 2), by chord length.

    Rings of under four corners and rings that repeat a corner in a row come back as they are.
    """
    ring = np.asarray(ring, float)
    if len(ring) > 1 and np.array_equal(ring[0], ring[-1]):
        ring = ring[:-1]
    step = np.linalg.norm(np.roll(ring, -1, 0) - ring, axis=1)
    if len(ring) < 4 or not (step > 0).all():
        return ring
    n, before = len(ring), np.roll(step, 1)
    slope = (np.roll(ring, -1, 0) - ring) / step[:, None]
    # Second derivatives at the corners: equal first derivatives on both sides of each.
    i = np.arange(n)
    a = np.zeros((n, n))
    a[i, i] = 2 * (before + step)
    a[i, i - 1] = before
    a[i, (i + 1) % n] = step
    bend = np.linalg.solve(a, 6 * (slope - np.roll(slope, 1, 0)))
    start = np.concatenate([[0.0], np.cumsum(step)])
    at = np.linspace(0, start[-1], samples, endpoint=False)
    k = np.clip(np.searchsorted(start, at, "right") - 1, 0, n - 1)
    t, h, nxt = (at - start[k])[:, None], step[k][:, None], (k + 1) % n
    linear = slope[k] - h * (2 * bend[k] + bend[nxt]) / 6
    return np.round(ring[k] + t * linear + t**2 * bend[k] / 2 + t**3 * (bend[nxt] - bend[k]) / (6 * h), 4)


def smooth_hulls(hulls: DataFrame, name: str, samples: int = 60) -> DataFrame:
    """name, xs, ys: hulls with rounded outlines (see :func:`smooth_ring`); one row a hull."""

    def run(frames):
        for f in frames:
            rings = [smooth_ring(np.column_stack([x, y]), samples) for x, y in zip(f["xs"], f["ys"], strict=True)]
            yield pd.DataFrame({name: f[name], "xs": [r[:, 0] for r in rings], "ys": [r[:, 1] for r in rings]})

    kind = dict(hulls.dtypes)[name]
    return hulls.select(name, "xs", "ys").mapInPandas(run, f"{name} {kind}, xs array<double>, ys array<double>")


def nearest_polygons(points: DataFrame, polygons: DataFrame, name: str, width: float) -> DataFrame:
    """id, nearest polygon (name, xs, ys: corners in order) and the distance to its edge, 0 inside; ties go to the lesser name.

    Polygons around a point are found by the cells of their bounding boxes, each filed at the width that it fits in.  Points outside all look for
    edges in their own and adjacent cells of ``width``, and where the nearest lies beyond a cell's width again in cells twice as
    wide, until all are settled.  Points without finite coordinates have no polygon; nor has any point if there are no corners.
    """
    kind = dict(polygons.dtypes)[name]
    shape = polygons.where(F.size("xs") > 0).select(F.col(name).alias("name"), *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("xs", "ys")])
    ring = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), lambda i: F.struct(*[F.get(c, (i + k) % F.size("xs")).alias(f"{c[0]}{k}") for k in (0, 1) for c in ("xs", "ys")]))
    shape = scratch(shape.withColumn("edges", ring), "polygons")
    finite = lambda c: F.col(c).between(-1e300, 1e300)
    left = points.where(finite("x") & finite("y")).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    # Inside: a box of size s is filed under the up to four cells of the width 2^l * width >= s.
    box = shape.select("name", "edges", *[f(c).alias(n) for n, f, c in (("lx", F.array_min, "xs"), ("hx", F.array_max, "xs"), ("ly", F.array_min, "ys"), ("hy", F.array_max, "ys"))])
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"), F.lit(width)) / width))).cast("int")
    box = box.withColumn("level", level)
    cell = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), "level") * width)).cast("long")
    filed = box.withColumn("cx", F.explode(F.sequence(cell("lx"), cell("hx")))).withColumn("cy", F.explode(F.sequence(cell("ly"), cell("hy"))))
    used = box.agg(F.sort_array(F.collect_set("level")).alias("levels"))  # one row, a number for each doubling
    asked = left.crossJoin(F.broadcast(used)).withColumn("level", F.explode("levels"))
    near = asked.select("id", "x", "y", "level", cell("x").alias("cx"), cell("y").alias("cy")).join(filed, ["level", "cx", "cy"])
    near = near.where(F.col("x").between(F.col("lx"), F.col("hx")) & F.col("y").between(F.col("ly"), F.col("hy")))
    x, y = F.col("x"), F.col("y")
    crossed = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < e["x0"] + (y - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"]))
    inside = near.where(F.size(F.filter("edges", crossed)) % 2 == 1).groupBy("id").agg(F.min("name").alias("name"))
    inside = scratch(inside, "inside")
    settled = [inside.select("id", "name", F.lit(0.0).alias("distance"))]
    left = scratch(left.join(inside.select("id"), "id", "left_anti"), "outside")

    edges = scratch(shape.select("name", F.inline("edges")), "edges")
    length = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    span = edges.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("x0"), F.abs("y0"))).alias("far"), F.avg(length).alias("long")).first()
    if span.n:
        reach = left.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far")).first().far or 0.0
        width = max(width, 2 * span.long)
        offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        t = F.least(F.greatest(((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
        d = F.sqrt(F.pow(F.col("x0") + t * dx - x, 2) + F.pow(F.col("y0") + t * dy - y, 2))
        while not left.isEmpty():
            at = lambda c: F.floor(c / width).cast("long")  # noqa: E731, B023
            cells_of = lambda c: F.explode(F.sequence(at(F.least(f"{c}0", f"{c}1")), at(F.greatest(f"{c}0", f"{c}1"))))  # noqa: E731, B023
            own = edges.withColumn("cx", cells_of("x")).withColumn("cy", cells_of("y"))
            looked = left.withColumn("o", F.explode(offs)).select("id", "x", "y", (at(x) + F.col("o.a")).alias("cx"), (at(y) + F.col("o.b")).alias("cy"))
            best = looked.join(own, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(d.alias("distance"), "name")).alias("m"))
            last = width > 2 * (span.far + reach) + 1
            got = scratch(left.join(best if last else best.where(F.col("m.distance") <= width), "id", "left"), "nearest-edges")
            settled.append(got.where("m IS NOT NULL").select("id", "m.name", "m.distance"))
            left = got.where("m IS NULL").select("id", "x", "y")
            if last:
                break
            width *= 2
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s.select("id", "name", "distance"))
    return points.select("id").join(out, "id", "left").select("id", F.col("name").cast(kind).alias(name), "distance")
