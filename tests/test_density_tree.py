"""The density tree against a slow version: all pairs, Prim's tree, and splits from the top down."""

import math

import numpy as np
import pytest

from rostrum.operators import density_tree


def shapes(kind, n, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "blobs":
        centres = rng.uniform(-8, 8, (5, 2))
        p = np.concatenate([c + rng.normal(0, s, (n // 6, 2)) for c, s in zip(centres, (0.3, 0.5, 0.8, 0.2, 1.0), strict=True)] + [rng.uniform(-10, 10, (n // 6, 2))])
    elif kind == "ring":
        a, r = rng.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 3 == 0, 2.0, 6.0) + rng.normal(0, 0.2, n)
        p = np.c_[r * np.cos(a), r * np.sin(a)]
    elif kind == "lattice":  # ties everywhere
        side = int(math.sqrt(n / 2))
        x, y = np.meshgrid(np.arange(side), np.arange(side))
        p = np.concatenate([np.c_[x.ravel(), y.ravel()], np.c_[x.ravel() + side + 4, y.ravel() * 1.0]]) * 0.5 + 0.01
    elif kind == "heaps":  # many points on one place
        p = np.concatenate([np.tile([[1.0, 1.0]], (n // 3, 1)), np.tile([[3.0, 1.0]], (n // 3, 1)), rng.uniform(-5, 5, (n // 3, 2))])
    else:  # far apart
        p = np.concatenate([rng.normal(0, 0.5, (n // 2, 2)), rng.normal(500, 0.5, (n // 2, 2)) * [1, -1]])
    return p


def slow(p, size, least, k):
    """(cells, n, clusters as (parent, points, birth, death, stability), cluster each cell fell out of)."""
    cells, n = np.unique(np.floor(p / size).astype(int), axis=0, return_counts=True)
    d2 = ((cells[:, None] - cells[None]) ** 2).sum(axis=2)
    if n.sum() <= k:
        return cells, n, [], np.full(len(cells), -1)
    core2 = []
    for row in d2:
        order = np.argsort(row, kind="stable")
        core2.append(row[order][np.searchsorted(np.cumsum(n[order]) - 1, k)])
    core2 = np.array(core2)
    w2 = np.maximum(d2, np.maximum(core2[:, None], core2[None]))
    inside, dist = [0], w2[0].copy()
    near, edges = np.zeros(len(cells), int), []
    out = np.ones(len(cells), bool)
    out[0] = False
    while len(inside) < len(cells):
        j = int(np.where(out, dist, np.iinfo(np.int64).max).argmin())
        edges.append((int(near[j]), j, int(dist[j])))
        out[j] = False
        inside.append(j)
        closer = w2[j] < dist
        dist, near = np.where(closer, w2[j], dist), np.where(closer, j, near)
    core = np.maximum(np.sqrt(core2), density_tree.INSIDE)
    clusters, fell, at = [], np.full(len(cells), -1), np.full(len(cells), np.inf)

    def parts(nodes, inner):
        adj = {v: [] for v in nodes}
        for a, b, _ in inner:
            adj[a].append(b)
            adj[b].append(a)
        seen, out_ = set(), []
        for v in sorted(nodes):
            if v not in seen:
                stack, own = [v], set()
                while stack:
                    x = stack.pop()
                    if x not in own:
                        own.add(x)
                        stack += adj[x]
                seen |= own
                out_.append(own)
        return [(o, [e for e in inner if e[0] in o]) for o in out_]

    todo = [(set(range(len(cells))), edges, None)] if n.sum() >= least else []
    while todo:
        nodes, inner, me = todo.pop()
        if me is None:
            me = len(clusters)
            clusters.append([-1, int(n[list(nodes)].sum()), 0.0, math.inf])
        if not inner:
            (v,) = nodes
            fell[v], at[v], clusters[me][2] = me, core[v], core[v]
            continue
        h2 = max(e[2] for e in inner)
        h = math.sqrt(h2)
        split = parts(nodes, [e for e in inner if e[2] < h2])
        real = [s for s in split if n[list(s[0])].sum() >= least]
        for s in split:
            if s not in real:
                for v in s[0]:
                    fell[v], at[v] = me, h
        if len(real) == 1:
            todo.append((*real[0], me))
            continue
        clusters[me][2] = h
        for s in real:
            clusters.append([me, int(n[list(s[0])].sum()), 0.0, h])
            todo.append((*s, len(clusters) - 1))
    for c, x in enumerate(clusters):
        born = 1 / x[3]
        x.append(sum(n[v] * (1 / at[v] - born) for v in np.flatnonzero(fell == c)) + sum(y[1] * (1 / x[2] - born) for y in clusters if y[0] == c))
    return cells, n, clusters, fell


def chosen(clusters):
    kids = {}
    for i, c in enumerate(clusters):
        kids.setdefault(c[0], []).append(i)

    def best(i):
        got = [best(k) for k in kids.get(i, [])]
        below, ids = sum(g[0] for g in got), [x for g in got for x in g[1]]
        own = clusters[i][4]
        return (below, ids) if clusters[i][0] < 0 or below > own + 1e-9 else (own, [i])

    return set(best(0)[1]) if clusters else set()


def above(clusters, i, stop):
    while i >= 0 and i not in stop:
        i = clusters[i][0]
    return i


def same_parts(a, b):
    """Equal up to the numbers of the parts; -1 means none in both."""
    a, b = list(a), list(b)
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in zip(a, b, strict=True))


def frame(spark, p):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")


@pytest.mark.parametrize(("kind", "n", "size", "least", "k"), [("blobs", 2000, 0.1, 15, 15), ("ring", 400, 0.25, 10, 5), ("lattice", 200, 0.5, 6, 4), ("heaps", 200, 0.5, 12, 12), ("far", 120, 0.2, 8, 8)])
def test_tree_and_labels_equal_the_slow_version(spark, kind, n, size, least, k):
    p = shapes(kind, n)
    cells, count, want, fell = slow(p, size, least, k)
    fitted = density_tree.fit(frame(spark, p), size, k)
    table = density_tree.merge_table(fitted, least).collect()
    key = lambda rows: sorted((a, round(b, 9), -1.0 if c is None or math.isinf(c) else round(c, 9), round(s, 6)) for a, b, c, s in rows)
    assert key((r.n, r.birth / size, r.death and r.death / size, r.stability) for r in table) == key(c[1:] for c in want)
    got = {r.id: r.cluster for r in density_tree.clusters(fitted, least).collect()}
    pick = chosen(want)
    place = {tuple(c): above(want, int(f), pick) for c, f in zip(cells.tolist(), fell, strict=True)}
    slow_labels = [place[tuple(c)] for c in np.floor(p / size).astype(int).tolist()]
    assert same_parts([got[i] for i in range(len(p))], slow_labels)
    counts = np.bincount([x for x in got.values() if x >= 0])
    assert all(counts[:-1] >= counts[1:])


def slow_cut(clusters, smallest):
    """Part of each cluster, walking from the root: the largest part of a split goes on as its parent."""
    part = {}

    def go(i, own):
        part[i] = own
        kids = [j for j, c in enumerate(clusters) if c[0] == i]
        large = [j for j in kids if clusters[j][1] >= smallest]
        top = max((clusters[j][1] for j in large), default=0)
        goes_on = [j for j in large if clusters[j][1] == top]
        for j in kids:
            go(j, j if j in large and (len(goes_on) != 1 or j != goes_on[0]) else own)

    if clusters:
        go(0, 0)
    return part


def test_level_cuts(spark):
    p = shapes("blobs", 1200)
    size, least = 0.2, 8
    cells, count, tree, fell = slow(p, size, least, least)
    smallest = [200, 60, 15]
    fitted = density_tree.fit(frame(spark, p), size, least)
    got = {r.id: r for r in density_tree.level_cuts(fitted, least, smallest, dominance=1e9).collect()}
    at = [tuple(c) for c in np.floor(p / size).astype(int).tolist()]
    for i, m in enumerate(smallest):
        part = slow_cut(tree, m)
        place = {tuple(c): part[int(f)] for c, f in zip(cells.tolist(), fell, strict=True)}
        mine = [got[j][f"level{i}"] for j in range(len(p))]
        assert same_parts(mine, [place[c] for c in at])
        assert min(mine) == 0  # exhaustive
        if i:
            pairs = {(got[j][f"level{i}"], got[j][f"level{i - 1}"]) for j in range(len(p))}
            assert len(pairs) == len({a for a, _ in pairs})  # nested
    strict = {r.id: r for r in density_tree.level_cuts(fitted, least, smallest, dominance=0.5).collect()}
    for i in range(3):
        if max(r[f"level{i}"] for r in got.values()) > 0:  # the largest part becomes noise, the others move up
            assert all(strict[j][f"level{i}"] == got[j][f"level{i}"] - 1 for j in got)


def labels(df, size, least):
    return density_tree.clusters(density_tree.fit(df, size, least), least)


def test_empty_few_and_broken_points(spark):
    empty = density_tree.fit(frame(spark, np.zeros((0, 2))), 1.0, 3)
    assert density_tree.clusters(empty, 3).count() == density_tree.merge_table(empty, 3).count() == 0
    assert {r.cluster for r in labels(frame(spark, np.ones((3, 2))), 1.0, 3).collect()} == {-1}
    odd = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, float("inf"), 0.0)] + [(10 + i, i * 0.01, 0.0) for i in range(5)], "id long, x double, y double")
    got = labels(odd, 1.0, 2).collect()
    assert len(got) == 8 and {r.cluster for r in got} == {-1}


def test_too_many_cells_are_refused(spark, monkeypatch):
    monkeypatch.setattr(density_tree, "MOST_CELLS", 10)
    with pytest.raises(ValueError, match="larger cell size"):
        labels(frame(spark, shapes("lattice", 60)), 0.5, 5)
