"""Outlines of the regions where a group is denser than the whole, as rings and polygons.

A grid of ratios becomes directed segments by marching squares: one projection over the squares between four cell centres,
inside on the left.  Every crossing of a grid line ends one segment and begins the next, so segments form closed rings; they are
named and put in order by pointer doubling, in rounds that grow with the logarithm of the longest ring.  Rings that run
clockwise are holes and belong to the smallest ring around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch
from .spatial import blur, cells

#: Segments of each case (sum of 1, 2, 4, 8 for the lower left, lower right, upper right and upper left corner inside), from
#: one side of the square to another.  5 and 10 are drawn as if the middle lay outside; 21 and 26 are the same with the middle inside.
CASES = {
    1: "bl", 2: "rb", 3: "rl", 4: "tr", 5: "bl tr", 6: "tb", 7: "tl", 8: "lt", 9: "bt", 10: "rb lt", 11: "rt", 12: "lr", 13: "br", 14: "lb",
    21: "br tl", 26: "lb rt",
}


def ratio_grid(points: DataFrame, group: str, size: float, sigma: float, floor: float = 0.02, least: int = 1000) -> DataFrame:
    """group, ix, iy, ratio: a group's share of its points in a cell over the share of all points there.

    Cells below ``floor`` of the densest say nothing and are left out; so are groups of fewer than ``least`` points and null groups.
    """
    named = points.where(F.col(group).isNotNull())
    sizes = named.groupBy(group).agg(F.count("*").alias("points")).where(F.col("points") >= least)
    total = blur(cells(points, size), sigma).withColumnRenamed("n", "all_n")
    limits = total.agg(F.max("all_n").alias("top"), F.sum("all_n").alias("sum_n"))
    dense = total.crossJoin(F.broadcast(limits)).where(F.col("all_n") > floor * F.col("top"))  # one row
    own = blur(cells(named.join(sizes.select(group), group, "left_semi"), size, [group]), sigma, [group])
    weight = own.groupBy(group).agg(F.sum("n").alias("group_n"))
    r = own.join(dense, ["ix", "iy"]).join(weight, group)
    ratio = (F.col("n") / F.col("group_n")) / (F.col("all_n") / F.col("sum_n"))
    return r.select(group, "ix", "iy", F.round(ratio, 7).alias("ratio"))


def segments(grid: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    """by, level, sx, sy, a, b, ax, ay, bx, by_: directed segments of every level in cell units, with the grid lines they end on.

    ``grid``: by, ix, iy, ratio at cell centres (ix + 0.5, iy + 0.5); absent cells count 0 and levels are above 0.
    """
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(-x).alias("dx"), F.lit(-y).alias("dy")) for k, (x, y) in enumerate(corners)])
    near = grid.select(*by, "ix", "iy", "ratio", F.explode(spots).alias("s"))
    near = near.select(*by, (F.col("ix") + F.col("s.dx")).alias("sx"), (F.col("iy") + F.col("s.dy")).alias("sy"), F.col("s.k").alias("k"), "ratio")
    v = [F.coalesce(F.max(F.when(F.col("k") == i, F.col("ratio"))), F.lit(0.0)).alias(f"v{i}") for i in range(4)]
    sq = near.groupBy(*by, "sx", "sy").agg(*v).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    case = sum((F.when(F.col(f"v{i}") >= F.col("level"), 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    middle = (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4 >= F.col("level")
    sq = sq.withColumn("case", case).where("case BETWEEN 1 AND 14")
    sq = sq.withColumn("case", F.when(F.col("case").isin(5, 10) & middle, F.col("case") + 16).otherwise(F.col("case")))
    part = lambda a, b: (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))
    x, y = F.col("sx"), F.col("sy")
    # A grid line between two neighbouring centres: h runs along x, v along y.
    line = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    ends = {
        "b": (line("h", x, y), x + part("v0", "v1"), y.cast("double")),
        "r": (line("v", x + 1, y), (x + 1).cast("double"), y + part("v1", "v2")),
        "t": (line("h", x, y + 1), x + part("v3", "v2"), (y + 1).cast("double")),
        "l": (line("v", x, y), x.cast("double"), y + part("v0", "v3")),
    }

    def segment(name: str) -> Column:
        (p, px, py), (q, qx, qy) = ends[name[0]], ends[name[1]]
        return F.struct(p.alias("a"), q.alias("b"), (px + 0.5).alias("ax"), (py + 0.5).alias("ay"), (qx + 0.5).alias("bx"), (qy + 0.5).alias("by_"))

    drawn = F.coalesce(*[F.when(F.col("case") == c, F.array(*map(segment, names.split()))) for c, names in CASES.items()])
    return sq.select(*by, "level", "sx", "sy", F.explode(drawn).alias("s")).select(*by, "level", "sx", "sy", "s.*")


def rings(segs: DataFrame, by: list[str], limit: int = 40) -> DataFrame:
    """The segments with ``ring`` (its least grid line) and ``place``, their number in the ring from 0."""
    key = [*by, "level"]
    cur = scratch(segs.select(*key, F.col("a").alias("node"), F.col("b").alias("to"), F.col("a").alias("least")), "rings")
    for _ in range(limit):
        ahead = cur.select(*key, F.col("node").alias("to"), F.col("to").alias("next"), F.col("least").alias("other"))
        new = cur.join(ahead, [*key, "to"]).select(*key, "node", F.col("next").alias("to"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved"))
        new = scratch(new, "rings")
        settled = new.where("moved").isEmpty()
        drop_scratch(cur)
        cur = new
        if settled:
            break
    named = cur.select(*key, F.col("node").alias("a"), F.col("least").alias("ring"))
    whole = scratch(segs.join(named, [*key, "a"]), "ring-segments")
    # The number of steps from the least line on: doubled, too, along the rings cut open before it.
    start = F.when(F.col("a") == F.col("ring"), None).otherwise(F.col("prev"))
    back = whole.join(whole.select(*key, F.col("b").alias("a"), F.col("a").alias("prev")), [*key, "a"])
    cur = scratch(back.select(*key, F.col("a").alias("node"), start.alias("to"), F.when(start.isNull(), 0).otherwise(1).cast("long").alias("place")), "places")
    for _ in range(limit):
        if cur.where("to IS NOT NULL").isEmpty():
            break
        ahead = cur.select(*key, F.col("node").alias("to"), F.col("to").alias("next"), F.col("place").alias("more"))
        new = scratch(cur.join(ahead, [*key, "to"], "left").select(*key, "node", F.col("next").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "places")
        drop_scratch(cur)
        cur = new
    return whole.join(cur.select(*key, F.col("node").alias("a"), "place"), [*key, "a"])


def polygons(segs: DataFrame, by: list[str], smallest: float = 4.0) -> DataFrame:
    """by, level, polygon, area, holes (their number), rings: array of (hole, xs, ys), the outer ring first; in cell units.

    Polygons of less than ``smallest`` cells, holes taken off, are noise and left out.
    """
    key = [*by, "level"]
    whole = scratch(rings(segs, by), "contour-rings")
    cross = (F.col("ax") * F.col("by_") - F.col("bx") * F.col("ay")) / 2
    spots = F.sort_array(F.collect_list(F.struct("place", "ax", "ay")))
    ring = whole.groupBy(*key, "ring").agg(F.sum(cross).alias("area"), spots.alias("spots"))
    ring = scratch(ring.select(*key, "ring", "area", F.transform("spots", lambda s: s["ax"]).alias("xs"), F.transform("spots", lambda s: s["ay"]).alias("ys")), "contour-ring")
    outer = ring.where("area > 0")
    # A ray from a hole's first crossing of a line between rows meets the segments of one row of squares only.
    probe = ring.where("area <= 0").select(*key, F.col("ring").alias("hole"), F.col("xs")[0].alias("px"), F.col("ys")[0].alias("py"))
    probe = probe.join(whole.where("place = 0").select(*key, F.col("ring").alias("hole"), "sy"), [*key, "hole"])
    walls = whole.join(outer.select(*key, "ring", F.col("area").alias("size")), [*key, "ring"]).select(*key, "sy", "ring", "size", "ax", "ay", "bx", "by_")
    met = probe.join(walls, [*key, "sy"]).where((F.col("ay") > F.col("py")) != (F.col("by_") > F.col("py")))
    at = F.col("ax") + (F.col("py") - F.col("ay")) / (F.col("by_") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    around = met.where(at < F.col("px")).groupBy(*key, "hole", "ring", "size").agg(F.count("*").alias("walls")).where("walls % 2 = 1")
    owner = around.groupBy(*key, "hole").agg(F.min(F.struct("size", "ring")).alias("m")).select(*key, "hole", F.col("m.ring").alias("owner"))
    holes = ring.join(owner.withColumnRenamed("hole", "ring"), [*key, "ring"]).select(*key, F.col("owner").alias("polygon"), F.lit(True).alias("hole"), "area", "xs", "ys")
    parts = outer.select(*key, F.col("ring").alias("polygon"), F.lit(False).alias("hole"), "area", "xs", "ys").unionByName(holes)
    got = parts.groupBy(*key, "polygon").agg(F.sum("area").alias("area"), F.count_if("hole").alias("holes"), F.sort_array(F.collect_list(F.struct("hole", "xs", "ys"))).alias("rings"))
    return got.where(F.col("area") >= smallest)
