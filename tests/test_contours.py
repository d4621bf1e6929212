"""Contours against walks along the segments, areas of the cells, and nesting by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import contours, spatial

GRID = "g string, ix long, iy long, ratio double"


def grid(spark, values, g="a"):
    return spark.createDataFrame([(g, int(x), int(y), float(v)) for (x, y), v in np.ndenumerate(values) if v], GRID)


def walk(segs):
    """{least start: (points in order, area)} by following the segments one by one."""
    nxt = {(s.a.kind, s.a.i, s.a.j): s for s in segs}
    assert len(nxt) == len(segs)  # one segment begins on a line
    out, seen = {}, set()
    for k in sorted(nxt):
        if k in seen:
            continue
        at, pts = k, []
        while at not in seen:
            seen.add(at)
            s = nxt[at]
            pts.append((s.ax, s.ay))
            at = (s.b.kind, s.b.i, s.b.j)
        assert at == k  # closed
        x, y = np.array(pts).T
        out[k] = (pts, float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_equal_a_walk_along_the_segments(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.random((17, 13)) * 3  # saddles everywhere
    v[3:6, 3:6] = 2.0  # values equal to a level
    segs = contours.segments(grid(spark, v), ["g"], [1.5, 2.0]).collect()
    rings = contours.rings(spark.createDataFrame(segs, contours.segments(grid(spark, v), ["g"], [1.5]).schema), ["g"]).collect()
    for level in (1.5, 2.0):
        want = walk([s for s in segs if s.level == level])
        got = {}
        for r in rings:
            if r.level == level:
                got.setdefault((r.ring.kind, r.ring.i, r.ring.j), {})[r.place] = (r.ax, r.ay)
        assert {k: [p[i] for i in range(len(p))] for k, p in got.items()} == {k: p for k, (p, _) in want.items()}
        # The enclosed area is that of the cells above the level, up to one cell for each square that the line passes.
        inside, passed = float((v >= level).sum()), len({(s.sx, s.sy) for s in segs if s.level == level})
        assert abs(sum(a for _, a in want.values()) - inside) <= passed


def test_polygons_with_holes_and_islands(spark):
    v = np.zeros((30, 30))
    v[2:25, 2:25] = 2
    v[5:20, 5:20] = 0  # a hole
    v[8:16, 8:16] = 2  # an island in it
    v[11:13, 11:13] = 0  # with a hole
    v[27, 27] = 2  # smaller than four cells
    v[27:30, 2:8] = 2
    got = contours.polygons(contours.segments(grid(spark, v), ["g"], [1.0]), ["g"]).collect()
    sizes = sorted((r.holes, round(r.area, 6)) for r in got)
    ring = lambda a, b: a * b - 0.5  # noqa: E731 (corners are cut by a half of a half square each)
    want = sorted([(1, ring(23, 23) - ring(15, 15)), (1, ring(8, 8) - ring(2, 2)), (0, ring(3, 6))])
    assert sizes == [(h, pytest.approx(a)) for h, a in want]
    for r in got:
        assert not r.rings[0].hole and all(x.hole for x in r.rings[1:])
    big = max(got, key=lambda r: r.area)
    assert 3 < min(big.rings[1].xs) < 6 and max(big.rings[1].xs) > 18


def test_ratio_of_a_group_and_the_least_number_of_points(spark):
    rng = np.random.default_rng(4)
    rows = [("left", *rng.normal((0, 0), 1)) for _ in range(300)] + [("right", *rng.normal((6, 0), 1)) for _ in range(300)] + [("few", 0.0, 0.0)] * 20 + [(None, 3.0, 0.0)] * 50
    pts = spark.createDataFrame([(i, g, float(x), float(y)) for i, (g, x, y) in enumerate(rows)], "id long, g string, x double, y double")
    r = contours.ratio_grid(pts, "g", 0.5, 1.0, least=100)
    assert {x.g for x in r.select("g").distinct().collect()} == {"left", "right"}
    total = {(c.ix, c.iy): c.n for c in spatial.blur(spatial.cells(pts, 0.5), 1.0).collect()}
    own = {(c.ix, c.iy): c.n for c in spatial.blur(spatial.cells(pts.where("g = 'left'"), 0.5), 1.0).collect()}
    got = {(c.ix, c.iy): c.ratio for c in r.where("g = 'left'").collect()}
    floor = 0.02 * max(total.values())
    want = {k: own[k] / sum(own.values()) / (total[k] / sum(total.values())) for k in own if total[k] > floor}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    shapes = contours.polygons(contours.segments(r, ["g"], [1.5]), ["g"]).groupBy("g").agg(F.avg(F.col("rings")[0]["xs"][0]).alias("x")).collect()
    assert {s.g: s.x * 0.5 < 3 for s in shapes} == {"left": True, "right": False}


def test_empty_and_flat_grids(spark):
    for df in (spark.createDataFrame([], GRID), grid(spark, np.full((3, 3), 0.5))):
        assert contours.polygons(contours.segments(df, ["g"], [1.0]), ["g"]).count() == 0
    one = contours.segments(grid(spark, np.full((1, 1), 2.0)), ["g"], [1.0])
    assert one.count() == 4 and contours.polygons(one, ["g"], 0.0).first().area == pytest.approx(0.5)
