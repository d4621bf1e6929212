import numpy as np

from rostrum.operators import spatial


def test_k_nearest_equals_brute_force_where_points_are_dense_or_equal(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 0.01, (400, 2)), rng.normal(0, 3, (80, 2)), np.full((40, 2), 0.25)])
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(900, 0.5, 0.5), (901, 0.5, 0.5 + 1e-9)]
    ask = [(i, x, y) for i, x, y in pts[::7]] + [(1000, 0.25, 0.25), (1001, 0.25, 0.25), (1002, 50.0, 50.0), (1003, 0.5, 0.5 + 2e-9)]
    p, q = (spark.createDataFrame(v, "id long, x double, y double") for v in (pts, ask))
    got = {(r.query_id, r.rank): (r.id, r.distance) for r in spatial.k_nearest(q, p, 1.2, 5, digits=7).collect()}
    want = {}
    for i, x, y in ask:
        near = sorted((round(float(np.hypot(a - x, b - y)), 7), j) for j, a, b in pts)
        want |= {(i, n): (j, d) for n, (d, j) in enumerate(near[:5], 1) if d < 1.2}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(v[1] - want[k][1]) < 2e-7 for k, v in got.items())
    assert got[(1003, 1)][0] == 900  # 901 is nearer by less than the digits
