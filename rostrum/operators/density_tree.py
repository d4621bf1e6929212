"""Hierarchical density clustering of point clouds: condensed tree, stable clusters and level cuts.

Points fall into square cells; from there on a cell stands for its points, so no later step grows with the points but with
the map's resolution.  Distances are between cells, in cells, and squared they are whole numbers, so ties are exact.

1. ``core_distances``: the distance within which a cell has ``k`` other points, looked for in ever wider blocks.
2. ``candidate_edges``: a few edges per pair of neighbouring blocks, on all widths at once, that contain a minimum
   spanning tree of mutual reachability, ``max(core, core, distance)``.
3. ``spanning_tree``: rounds in which every tree takes its lightest edge to another one.
4. ``merge_table``: the tree's edges in order of weight; all that meet at one height merge at once, so the result does
   not depend on the order of ties.  Groups of ``least`` points are clusters, smaller ones fall out of the cluster they touch.

Why the candidates suffice.  Take blocks of ``b`` by ``b`` cells.  Cells of one block with core distances up to the block's
diagonal are connected by lighter edges than the diagonal, so of all edges between two such groups only the lightest can be in the
tree, and it starts at the outermost cell of some row (or column) of its block on the side of the other block.  Cells with
a larger core distance number at most ``k`` in a block and are kept one by one.  Edges up to the diagonal of twice the
block are looked for between blocks at most three apart, longer ones with wider blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch
from .graph import top_ancestors

#: Cells of one map: the merge table is built in one task.
MOST_CELLS = 1 << 21
#: Distance of points that share a cell, in cells.
INSIDE = 0.5


def cell_counts(points: DataFrame, size: float) -> DataFrame:
    """ix, iy, n of occupied cells; points without finite coordinates are in none."""
    ix, iy = (F.floor(F.col(c) / size).cast("long") for c in "xy")
    finite = F.col("x").between(-1e300, 1e300) & F.col("y").between(-1e300, 1e300)
    return points.where(finite).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"))


def _neighbours(reach: int) -> Column:
    side = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in side for b in side])


def core_distances(cells: DataFrame, k: int) -> DataFrame:
    """ix, iy, n, core2: squared distance to the ``k``-th other point; null where there are fewer points."""
    own = F.when(F.col("n") > k, F.lit(0).cast("long"))
    left = cells.select("ix", "iy", "n")
    done = [left.where(F.col("n") > k).withColumn("core2", own)]
    left = left.where(F.col("n") <= k)
    span = cells.agg(F.max("ix") - F.min("ix"), F.max("iy") - F.min("iy")).first()
    width = 2
    while span[0] is not None:
        block = lambda c: F.floor(F.col(c) / width).cast("long")  # noqa: E731, B023
        asked = left.withColumn("o", F.explode(_neighbours(1))).select("ix", "iy", "n", (block("ix") + F.col("o.a")).alias("bx"), (block("iy") + F.col("o.b")).alias("by"))
        near = cells.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("n").alias("m"), block("ix").alias("bx"), block("iy").alias("by"))
        d2 = (F.col("ix") - F.col("jx")) * (F.col("ix") - F.col("jx")) + (F.col("iy") - F.col("jy")) * (F.col("iy") - F.col("jy"))
        ring = asked.join(near, ["bx", "by"]).select("ix", "iy", "n", d2.alias("d2"), "m").where(F.col("d2") <= width * width).groupBy("ix", "iy", "n", "d2").agg(F.sum("m").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("ix", "iy").orderBy("d2"))
        # The cell's own points are at distance 0, one of them is the point itself.
        hit = ring.withColumn("upto", upto - 1).where(F.col("upto") >= k).groupBy("ix", "iy").agg(F.min("d2").alias("core2"))
        got = scratch(left.join(hit, ["ix", "iy"], "left"), "core")
        done.append(got.where("core2 IS NOT NULL"))
        left = got.where("core2 IS NULL").select("ix", "iy", "n")
        if width > span[0] + span[1] or left.isEmpty():
            break
        width *= 4
    done.append(left.withColumn("core2", F.lit(None).cast("long")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return scratch(out, "cores")


def candidate_edges(cores: DataFrame) -> DataFrame:
    """u, v, w2: edges between cells (structs of ix, iy) that contain a minimum spanning tree of mutual reachability."""
    known = cores.where("core2 IS NOT NULL")
    low = known.agg(F.min("ix"), F.min("iy"), F.max("ix"), F.max("iy")).first()
    if low[0] is None:
        return known.select(F.struct("ix", "iy").alias("u"), F.struct("ix", "iy").alias("v"), F.col("core2").alias("w2"))
    span = max(low[2] - low[0], low[3] - low[1]) + 1
    steps = [(j, 1 << j, 2 * ((1 << j) - 1) ** 2, 2 * ((2 << j) - 1) ** 2) for j in range(max(1, math.ceil(math.log2(span))) + 1)]
    sizes = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(b).alias("b"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for j, b, lo, hi in steps])
    at = known.select("ix", "iy", "core2", F.explode(sizes).alias("s")).select("ix", "iy", "core2", "s.*").where("core2 <= hi")
    at = at.withColumn("bx", F.floor((F.col("ix") - low[0]) / F.col("b")).cast("long")).withColumn("by", F.floor((F.col("iy") - low[1]) / F.col("b")).cast("long"))
    fresh = at.where("core2 > lo")
    cell = F.struct("ix", "iy")
    block = ["j", "bx", "by"]

    def rim(line: str, along: str, last: bool) -> DataFrame:
        """The settled cells of a block that are outermost in their row or column, and all cells that are new at this width."""
        pick = (F.max if last else F.min)(F.struct(along, "core2"))
        settled = at.where("core2 <= lo").groupBy(*block, "lo", "hi", line).agg(pick.alias("p"))
        settled = settled.select(*block, "lo", "hi", *[F.col(line) if c == line else F.col(f"p.{c}").alias(c) for c in ("ix", "iy")], F.col("p.core2").alias("core2"), F.lit(None).cast("struct<ix:bigint,iy:bigint>").alias("own"))
        return settled.unionByName(fresh.select(*block, "lo", "hi", "ix", "iy", "core2", cell.alias("own")))

    def pairs(a: DataFrame, b: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
        off = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])
        left = a.withColumn("o", F.explode(off)).select(
            "j", (F.col("bx") + F.col("o.x")).alias("bx"), (F.col("by") + F.col("o.y")).alias("by"), F.col("bx").alias("ax"), F.col("by").alias("ay"), "lo", "hi",
            cell.alias("u"), F.col("core2").alias("cu"), F.col("own").alias("gu"),
        )
        right = b.select(*block, cell.alias("v"), F.col("core2").alias("cv"), F.col("own").alias("gv"))
        dx, dy = F.col("u.ix") - F.col("v.ix"), F.col("u.iy") - F.col("v.iy")
        w2 = F.greatest(dx * dx + dy * dy, "cu", "cv")
        met = left.join(right, block).withColumn("w2", w2).where("w2 > lo AND w2 <= hi")
        best = met.groupBy(*block, "ax", "ay", "gu", "gv").agg(F.min(F.struct("w2", "u", "v")).alias("e"))
        return best.select("e.u", "e.v", "e.w2")

    aside = [(x, y) for x in (1, 2, 3) for y in range(-3, 4)]
    across = pairs(rim("iy", "ix", True), rim("iy", "ix", False), aside)
    above = pairs(rim("ix", "iy", True), rim("ix", "iy", False), [(0, 1), (0, 2), (0, 3)])
    # Inside a block a new cell reaches all others at its own core distance: one edge to the least of them.
    least = at.groupBy(*block).agg(F.min(F.struct("core2", "ix", "iy")).alias("m")).select(*block, F.struct("m.ix", "m.iy").alias("v"))
    inside = fresh.join(least, block).select(cell.alias("u"), "v", F.col("core2").alias("w2")).where("u <> v")
    return across.unionByName(above).unionByName(inside)


def spanning_tree(edges: DataFrame, limit: int = 60) -> DataFrame:
    """u, v, w2: a minimum spanning forest of the edges, by rounds that join every tree with its nearest one."""
    cur = scratch(edges.select("u", "v", "w2", F.col("u").alias("a"), F.col("v").alias("b")), "tree-edges")
    taken = []
    for _ in range(limit):
        ends = cur.select(F.col("a").alias("node"), F.col("b").alias("other"), "w2", "u", "v").unionByName(cur.select(F.col("b").alias("node"), F.col("a").alias("other"), "w2", "u", "v"))
        # One order of all edges, so that what trees choose never closes a circle.
        best = scratch(ends.groupBy("node").agg(F.min(F.struct("w2", "u", "v", "other")).alias("e")).select("node", "e.*"), "tree-picks")
        if best.isEmpty():
            break
        taken.append(scratch(best.select("u", "v", "w2").distinct(), "tree"))
        # Two trees that chose each other: the lesser one leads.
        back = best.select(F.col("node").alias("other"), F.col("other").alias("node"), F.lit(True).alias("both"))
        up = best.select("node", "other").join(back, ["node", "other"], "left").where("both IS NULL OR node > other").select(F.col("node").alias("child"), F.col("other").alias("parent"))
        tops = top_ancestors(up, best.select("node")).select("node", "top")
        moved = cur.join(tops.toDF("a", "ta"), "a").join(tops.toDF("b", "tb"), "b").where("ta <> tb")
        w = moved.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.min(F.struct("w2", "u", "v")).alias("e"))
        new = scratch(w.select("e.u", "e.v", "e.w2", "a", "b"), "tree-edges")
        drop_scratch(cur, best)
        cur = new
    out = cur.select("u", "v", "w2").limit(0) if not taken else taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


class Tree:
    """Condensed tree of weighted nodes from the edges of a spanning tree; distances in cells.

    ``n``: points of each node; ``core``: the distance at which a node's own points are together; ``edges``:
    (i, j, height).  Groups below ``least`` points are dust.
    """

    def __init__(self, n: np.ndarray, core: np.ndarray, u: np.ndarray, v: np.ndarray, height: np.ndarray, least: int):
        self.n, self.least = n, least
        k = len(n)
        self.parent_of: list[int] = [-1] * k  # of groups, nodes first
        self.own: list[tuple[int, float] | None] = [None] * k  # (cluster, height) its points fell out at
        self.size: list[int] = n.tolist()
        self.cluster: list[int] = [-1] * k  # the cluster that a group is now part of
        self.parent: list[int] = []  # of clusters
        self.top: list[float] = []
        self.bottom: list[float] = []
        self.points: list[int] = []
        self.split: list[float] = []  # sum over sub-clusters of points / height of the split
        for i in np.flatnonzero(n >= least).tolist():
            self.cluster[i] = self._new(float(core[i]), int(n[i]))
            self.own[i] = (self.cluster[i], float(core[i]))
        leader = list(range(k))
        group = list(range(k))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        order = np.argsort(height, kind="stable")
        at = 0
        while at < len(order):
            h, end = height[order[at]], at
            met: dict[int, list[int]] = {}
            while end < len(order) and height[order[end]] == h:
                a, b = find(int(u[order[end]])), find(int(v[order[end]]))
                end += 1
                if a == b:
                    continue
                x, y = met.pop(a, None) or [group[a]], met.pop(b, None) or [group[b]]
                if len(x) < len(y):
                    a, b, x, y = b, a, y, x
                leader[b] = a
                x.extend(y)
                met[a] = x
            for root, parts in met.items():
                group[root] = self._merge(parts, float(h))
            at = end

    def _new(self, bottom: float, points: int) -> int:
        self.parent.append(-1)
        self.top.append(math.inf)
        self.bottom.append(bottom)
        self.points.append(points)
        self.split.append(0.0)
        return len(self.parent) - 1

    def _merge(self, parts: list[int], h: float) -> int:
        g, total = len(self.size), sum(self.size[p] for p in parts)
        real = [p for p in parts if self.cluster[p] >= 0]
        if not real:
            c = self._new(h, total) if total >= self.least else -1
        elif len(real) == 1:
            c = self.cluster[real[0]]
        else:
            c = self._new(h, total)
            for p in real:
                x = self.cluster[p]
                self.parent[x], self.top[x] = c, h
                self.split[c] += self.size[p] / h
        if c >= 0:
            self.points[c] = total
            for p in parts:
                if self.cluster[p] < 0:
                    self.own[p] = (c, h)
        for p in parts:
            self.parent_of[p] = g
        self.parent_of.append(-1)
        self.own.append(None)
        self.size.append(total)
        self.cluster.append(c)
        return g

    def fallen(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node the cluster that its points fell out of (-1: none) and the height."""
        own = list(self.own)
        for g in range(len(own) - 1, -1, -1):
            p = self.parent_of[g]
            if own[g] is None and p >= 0:
                own[g] = own[p]
        got = [o or (-1, math.inf) for o in own[: len(self.n)]]
        return np.array([c for c, _ in got], np.int64), np.array([h for _, h in got])

    def stabilities(self, fell: np.ndarray, height: np.ndarray) -> np.ndarray:
        """Sum over a cluster's points of the time, in 1 / distance, that they are in it."""
        c = len(self.parent)
        out = np.array(self.split) - np.array(self.points) / np.array(self.top) if c else np.zeros(0)
        inside = fell >= 0
        return out + np.bincount(fell[inside], self.n[inside] / height[inside], minlength=c)

    def stable(self, stability: np.ndarray) -> np.ndarray:
        """For each cluster the chosen one it belongs to, or -1; the root is never chosen, parents win ties."""
        c = len(self.parent)
        below, chosen = np.zeros(c), np.zeros(c, bool)
        for x in range(c):  # parents come after their parts
            if self.parent[x] < 0:
                continue
            chosen[x] = stability[x] >= below[x]
            below[self.parent[x]] += max(stability[x], below[x])
        out = np.full(c, -1, np.int64)
        for x in range(c - 1, -1, -1):
            up = out[self.parent[x]] if self.parent[x] >= 0 else -1
            out[x] = up if up >= 0 else x if chosen[x] else -1
        return out

    def cut(self, smallest: int) -> np.ndarray:
        """For each cluster the part it belongs to when only splits into parts of ``smallest`` points count.

        Of the parts of a split that are large enough all but the largest (ties: the later one) are parts of their own.
        """
        c = len(self.parent)
        heavy = np.full(c, -1, np.int64)
        for x in range(c):
            p = self.parent[x]
            if p >= 0 and self.points[x] >= smallest and (heavy[p] < 0 or self.points[x] >= self.points[heavy[p]]):
                heavy[p] = x
        out = np.arange(c)
        for x in range(c - 1, -1, -1):
            p = self.parent[x]
            if p >= 0 and (self.points[x] < smallest or heavy[p] == x):
                out[x] = out[p]
        return out


def _numbered(part: np.ndarray, n: np.ndarray, dominance: float | None = None) -> np.ndarray:
    """Parts numbered from 0 by points, then by their first node; -1 stays, and so becomes a part that outweighs all others."""
    ids, first, which = np.unique(part, return_index=True, return_inverse=True)
    points = np.bincount(which, n, minlength=len(ids))
    order = [i for i in np.lexsort((first, -points)) if ids[i] >= 0]
    if dominance and len(order) > 1 and points[order[0]] > dominance * points[order[1]]:
        order = order[1:]
    number = np.full(len(ids), -1, np.int64)
    number[order] = np.arange(len(order))
    return number[which]


def _whole(known: DataFrame, tree: DataFrame, columns: str, run) -> DataFrame:
    """``run(cells, edges)`` over all cells of one map; their number is bounded by ``MOST_CELLS`` and checked."""
    count = known.count()
    if count > MOST_CELLS:
        raise ValueError(f"{count} cells: take a larger cell size, the merge table holds up to {MOST_CELLS}")
    e = tree.select(F.col("u.ix").alias("ux"), F.col("u.iy").alias("uy"), F.col("v.ix").alias("vx"), F.col("v.iy").alias("vy"), "w2", F.lit(0).alias("g"))

    def one(cells: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["ix", "iy"], ignore_index=True)
        place = pd.Series(np.arange(len(cells)), index=pd.MultiIndex.from_frame(cells[["ix", "iy"]]))
        u, v = (place.reindex(pd.MultiIndex.from_arrays([edges[a], edges[b]])).to_numpy() for a, b in (("ux", "uy"), ("vx", "vy")))
        core = np.maximum(np.sqrt(cells["core2"].to_numpy(float)), INSIDE)
        return run(cells, core, u, v, np.sqrt(edges["w2"].to_numpy(float)))

    return known.withColumn("g", F.lit(0)).groupBy("g").cogroup(e.groupBy("g")).applyInPandas(one, columns)


@dataclass
class Fitted:
    """Cells with their core distances and the spanning tree of a cloud of points (id, x, y)."""

    points: DataFrame
    size: float
    k: int
    known: DataFrame
    tree: DataFrame

    def to_points(self, labels: DataFrame, names: list[str]) -> DataFrame:
        ix, iy = (F.floor(F.col(c) / self.size).cast("long") for c in "xy")
        got = self.points.select("id", ix.alias("ix"), iy.alias("iy")).join(labels, ["ix", "iy"], "left")
        return got.select("id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in names])


def fit(points: DataFrame, size: float, k: int) -> Fitted:
    """``size``: width of a cell; ``k``: the neighbour that gives the core distance."""
    cells = scratch(cell_counts(points, size), "cells")
    cores = core_distances(cells, k)
    return Fitted(points, size, k, cores.where("core2 IS NOT NULL"), spanning_tree(candidate_edges(cores)))


def clusters(fitted: Fitted, least: int) -> DataFrame:
    """id, cluster (0 is the largest, -1 noise): the most stable clusters of at least ``least`` points.

    Points without finite coordinates are noise, and so is everything if there are not more than ``k`` points, or one cluster only.
    """

    def run(cells, core, u, v, height):
        t = Tree(cells["n"].to_numpy(), core, u, v, height, least)
        fell, at = t.fallen()
        chosen = np.append(t.stable(t.stabilities(fell, at)), -1)
        return pd.DataFrame({"ix": cells["ix"], "iy": cells["iy"], "cluster": _numbered(chosen[fell], t.n)})

    return fitted.to_points(_whole(fitted.known, fitted.tree, "ix long, iy long, cluster long", run), ["cluster"])


def merge_table(fitted: Fitted, least: int) -> DataFrame:
    """cluster, parent (null: the root), n, birth and death distance (null: never), stability and whether it is chosen."""
    size = fitted.size

    def run(cells, core, u, v, height):
        t = Tree(cells["n"].to_numpy(), core, u, v, height, least)
        s = t.stabilities(*t.fallen())
        death = [None if math.isinf(x) else x * size for x in t.top]
        picked = t.stable(s) == np.arange(len(s))
        return pd.DataFrame({"cluster": np.arange(len(s)), "parent": t.parent, "n": t.points, "birth": np.array(t.bottom) * size, "death": death, "stability": s, "chosen": picked})

    got = _whole(fitted.known, fitted.tree, "cluster long, parent long, n long, birth double, death double, stability double, chosen boolean", run)
    return got.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def level_cuts(fitted: Fitted, least: int, smallest: list[int], dominance: float = 4.0) -> DataFrame:
    """id and level0, level1, ..: one cut of the condensed tree for each threshold, coarse to fine.

    Every cut is exhaustive: dust and splits into parts below the threshold belong to the part around them.  A largest part of
    over ``dominance`` times the second is a remainder, not a subject, and becomes -1.  Cuts of one tree nest: a part of
    a finer level lies in one part of each coarser one.
    """
    names = [f"level{i}" for i in range(len(smallest))]

    def run(cells, core, u, v, height):
        t = Tree(cells["n"].to_numpy(), core, u, v, height, least)
        fell, _ = t.fallen()
        out = {"ix": cells["ix"], "iy": cells["iy"]}
        for name, m in zip(names, smallest, strict=True):
            out[name] = _numbered(np.append(t.cut(m), -1)[fell], t.n, dominance)
        return pd.DataFrame(out)

    schema = "ix long, iy long, " + ", ".join(f"{c} long" for c in names)
    return fitted.to_points(_whole(fitted.known, fitted.tree, schema, run), names)
