"""Multi-step analyses: contingency, vectors, space and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import contingency, contours, density_tree, graph, similarity, spatial, terms
from ..operators.relational import best_per_group
from .core import TAG, tagged
from ..session import scratch
from .registry import query
from .texts import U


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))


_PTS = "(SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y FROM embeddings)"


# Contingency


@query(f"""WITH c AS (SELECT n_name AS r, p_brand AS c, count(*) AS n FROM {TAG} GROUP BY 1, 2), rt AS (SELECT r, sum(n) AS row_total FROM c GROUP BY 1 HAVING sum(n) >= 3), ct AS (SELECT c, sum(n) AS col_total FROM c GROUP BY 1 HAVING sum(n) >= 2)
  SELECT r, c, n, CAST(row_total AS BIGINT) AS row_total, CAST(col_total AS BIGINT) AS col_total FROM c JOIN rt USING (r) JOIN ct USING (c)""")
def c01_trimmed_contingency(spark, sf_dir):
    c = tagged(spark, sf_dir).groupBy(F.col("n_name").alias("r"), F.col("p_brand").alias("c")).agg(F.count("*").alias("n"))
    return contingency.trim(c, "r", "c", "n").select("r", "c", "n", "row_total", "col_total")


@query()
def c01_c03_correspondence(spark, sf_dir):
    c = tagged(spark, sf_dir).groupBy(F.col("n_name").alias("r"), F.col("p_brand").alias("c")).agg(F.count("*").alias("n"))
    ca = contingency.analyse(c, "r", "c", "n")
    rows = [("row", str(x), float(f[0]), float(f[1])) for x, f in zip(ca.rows, ca.row_coords, strict=True)]
    rows += [("col", str(x), float(f[0]), float(f[1])) for x, f in zip(ca.cols, ca.col_coords, strict=True)]
    rows += [("inertia", str(i + 1), float(s), 0.0) for i, s in enumerate(ca.inertia)]
    return spark.createDataFrame(rows, "kind string, name string, x double, y double")


@query(f"""WITH c AS (SELECT n_name AS r, p_type AS c, CAST(count(*) AS DOUBLE) AS n FROM {TAG} GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), rt AS (SELECT r, sum(n) AS rn FROM c GROUP BY 1), ct AS (SELECT c, sum(n) AS cn FROM c GROUP BY 1)
  SELECT round(sum(pow(coalesce(n, 0) / t - rn / t * cn / t, 2) / (rn / t * cn / t)), 9) AS total_inertia FROM rt CROSS JOIN ct LEFT JOIN c USING (r, c), t""")
def c01_total_inertia(spark, sf_dir):
    c = tagged(spark, sf_dir).groupBy(F.col("n_name").alias("r"), F.col("p_type").alias("c")).agg(F.count("*").cast("double").alias("n"))
    t, rt, ct = c.agg(F.sum("n").alias("t")), c.groupBy("r").agg(F.sum("n").alias("rn")), c.groupBy("c").agg(F.sum("n").alias("cn"))
    # sum over all cells of (p - e)^2 / e = sum over observed cells of p^2 / e - 1: absent cells need not be made.
    e = F.col("rn") * F.col("cn") / F.col("t") / F.col("t")
    p = F.col("n") / F.col("t")
    return c.join(rt, "r").join(ct, "c").crossJoin(F.broadcast(t)).agg(F.round(F.sum(p * p / e) - 1, 9).alias("total_inertia"))  # one row


# Vectors

_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (3, 77, 150)), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT query_id, vec_id, round(list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)), 7) AS score FROM e JOIN q ON vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)) DESC, vec_id) <= 10""")
def j29_top_k_cosine(spark, sf_dir):
    return similarity.top_k_cosine(table(spark, sf_dir, "embeddings"), [3, 77, 150], 10).select("query_id", "vec_id", F.round("score", 7).alias("score"))


@query("""WITH p AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS c FROM p GROUP BY 1, 2),
  s AS (SELECT p.label, vec_id, round(sum(v * c) / sqrt(sum(v * v)) / sqrt(sum(c * c)), 6) AS score FROM p JOIN c ON p.label = c.label AND p.i = c.i GROUP BY 1, 2)
  SELECT label, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 3""")
def c17_m10_medoids(spark, sf_dir):
    m = similarity.medoids(table(spark, sf_dir, "embeddings"), "label", 1000000).withColumn("score", F.round("score", 6))
    return best_per_group(m, ["label"], [F.desc("score"), F.col("vec_id")], 3).select("label", "vec_id", "score")


@query()
def c10_projection(spark, sf_dir):
    from ..operators.projection import pca

    return pca(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 2)


@query()
def c12_level_cuts(spark, sf_dir):
    from ..operators.projection import levels

    return levels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [3, 9, 27])


@query()
def c19_agglomerative(spark, sf_dir):
    from ..operators.projection import linkage

    return linkage(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.5)


_COS = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


@query(f"""WITH e AS (SELECT label, vec_id, embedding AS v, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings), f AS (SELECT label, min(vec_id) AS k, arg_min(v, vec_id) AS fv FROM e GROUP BY 1),
  s AS (SELECT label, avg({_COS.format(a='v', b='fv')}) AS similarity FROM e JOIN f USING (label) WHERE vec_id <> k GROUP BY 1),
  p AS (SELECT label, v, coalesce(lead(v) OVER w, first_value(v) OVER w) AS pv FROM e WINDOW w AS (PARTITION BY substr(h, 1, 2) ORDER BY h, vec_id)), b AS (SELECT label, count(*) AS n, avg({_COS.format(a='v', b='pv')}) AS baseline FROM p GROUP BY 1)
  SELECT label, n, round(similarity, 7) AS similarity, round(baseline, 7) AS baseline FROM b LEFT JOIN s USING (label)""")
def c19_pair_similarity(spark, sf_dir):
    from ..operators.projection import pair_similarity

    got = pair_similarity(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding")
    return got.select("label", "n", *[F.round(c, 7).alias(c) for c in ("similarity", "baseline")])


@query(f"SELECT a.id AS vec_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 7) AS distance FROM {_PTS} a JOIN (SELECT label, avg(x) AS x, avg(y) AS y FROM {_PTS} GROUP BY 1) b ON a.label = b.label")
def c32_distance_to_cluster(spark, sf_dir):
    p = points(spark, sf_dir)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return p.join(c, "label").select(F.col("id").alias("vec_id"), F.round(d, 7).alias("distance"))


# Space


_DENSITY = f"""WITH c AS (SELECT CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, count(*) AS n FROM {_PTS} GROUP BY 1, 2), k AS (SELECT d, exp(-(d * d) / 2.0) AS w FROM (SELECT unnest(range(-3, 4)) AS d)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
  a AS (SELECT ix + d AS ix, iy, sum(n * w) AS n FROM c, kn GROUP BY 1, 2), b AS (SELECT ix, iy + d AS iy, sum(n * w) AS n FROM a, kn GROUP BY 1, 2) SELECT ix, iy, sqrt(n / max(n) OVER ()) AS value FROM b"""


@query(f"SELECT ix, iy, round(value, 7) AS value FROM ({_DENSITY})")
def c20_density_grid(spark, sf_dir):
    return spatial.density(points(spark, sf_dir), 0.25, 1.0).select("ix", "iy", F.round("value", 7).alias("value"))


@query(f"""WITH g AS ({_DENSITY}), q AS (SELECT id, x / 0.25 - 0.5 AS fx, y / 0.25 - 0.5 AS fy FROM {_PTS}), k AS (SELECT id, CAST(floor(fx) AS BIGINT) + a AS ix, CAST(floor(fy) AS BIGINT) + b AS iy,
  CASE a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * CASE b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END AS w FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
  SELECT id, round(sum(w * coalesce(value, 0)), 7) AS value FROM k LEFT JOIN g USING (ix, iy) GROUP BY 1""")
def c20_bilinear_sample(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.sample(p.select("id", "x", "y"), spatial.density(p, 0.25, 1.0), 0.25).select("id", F.round("value", 7).alias("value"))


_THIN = f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY -ln({U.format(id='id')}), id) AS rank FROM {_PTS}), z AS (SELECT *, CAST(least(greatest(floor((x + 10) / 20 * pow(2, z)), 0), pow(2, z) - 1) AS INT) AS tx, CAST(least(greatest(floor((10 - y) / 20 * pow(2, z)), 0), pow(2, z) - 1) AS INT) AS ty FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS z)),
  b AS (SELECT z, max(n) OVER (ORDER BY z) AS budget FROM (SELECT z, count(DISTINCT (tx, ty)) * 20 AS n FROM z GROUP BY 1)) SELECT z, tx, ty, id, x, y, rank FROM z JOIN b USING (z) WHERE rank <= budget"""


@query(f"SELECT z, tx, ty, id, rank FROM ({_THIN})")
def c21_w04_thinning(spark, sf_dir):
    return spatial.thin(points(spark, sf_dir), [0, 1, 2, 3, 4], 20, -10.0, 10.0, F.lit(1.0)).select("z", "tx", "ty", "id", "rank")


_SAMPLED = f"""(WITH g AS ({_DENSITY}), q AS (SELECT id, x / 0.25 - 0.5 AS fx, y / 0.25 - 0.5 AS fy FROM {_PTS}), k AS (SELECT id, CAST(floor(fx) AS BIGINT) + a AS ix, CAST(floor(fy) AS BIGINT) + b AS iy,
  CASE a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * CASE b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END AS w FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
  SELECT id, round(sum(w * coalesce(value, 0)), 6) AS d FROM k LEFT JOIN g USING (ix, iy) GROUP BY 1)"""


@query("SELECT z, tx, ty, id, rank FROM (" + _THIN.replace(f"ORDER BY -ln({U.format(id='id')}), id) AS rank FROM {_PTS})", f"ORDER BY -ln({U.format(id='id')}) / (1 / (d + 0.01)), id) AS rank FROM {_PTS} JOIN {_SAMPLED} USING (id))") + ")")
def c21_density_thinning(spark, sf_dir):
    """Points in dense places have little weight, so thinning leaves them out first."""
    p = points(spark, sf_dir)
    d = spatial.sample(p.select("id", "x", "y"), spatial.density(p, 0.25, 1.0), 0.25).select("id", F.round("value", 6).alias("d"))
    return spatial.thin(p.join(d, "id"), [0, 1, 2, 3, 4], 20, -10.0, 10.0, 1 / (F.col("d") + 0.01)).select("z", "tx", "ty", "id", "rank")


@query(f"""WITH t AS ({_THIN}), s AS (SELECT id, x, y FROM t WHERE z = 2), p AS (SELECT p.id, s.id AS sid, pow(p.x - s.x, 2) + pow(p.y - s.y, 2) AS d FROM {_PTS} p, s)
  SELECT sid AS id, count(*) AS point_count FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, sid) = 1) GROUP BY 1""".replace("[0, 1, 2, 3, 4]", "[2]"))
def j26_nearest_survivor_counts(spark, sf_dir):
    p = points(spark, sf_dir)
    shown = spatial.thin(p, [2], 20, -10.0, 10.0, F.lit(1.0))
    return spatial.survivors(shown, p.select("id", "x", "y"), 2, -10.0, 10.0)


@query(f"""WITH c AS (SELECT label, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, count(*) AS n FROM {_PTS} GROUP BY 1, 2, 3) SELECT label, count(*) AS filled, round(quantile_cont(n, 0.5) / 256, 9) AS p50, round(quantile_cont(n, 0.9) / 256, 9) AS p90, round(quantile_cont(n, 0.99) / 256, 9) AS p99, round(max(n) / 256.0, 9) AS top FROM c GROUP BY 1""")
def a37_s16_ink_density(spark, sf_dir):
    c = spatial.cells(points(spark, sf_dir), 1.0, ["label"])
    p = lambda q: F.round(F.percentile("n", F.lit(q)) / 256, 9)
    return c.groupBy("label").agg(F.count("*").alias("filled"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.round(F.max("n") / 256, 9).alias("top"))


def _blurred(where: str) -> str:
    return f"""(WITH c AS (SELECT CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, count(*) AS n FROM {_PTS} WHERE {where} GROUP BY 1, 2), k AS (SELECT d, exp(-(d * d) / 2.0) AS w FROM (SELECT unnest(range(-3, 4)) AS d)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
  a AS (SELECT ix + d AS ix, iy, sum(n * w) AS n FROM c, kn GROUP BY 1, 2) SELECT ix, iy + d AS iy, sum(n * w) AS n FROM a, kn GROUP BY 1, 2)"""


@query(f"""WITH t AS {_blurred('true')}, g AS {_blurred('label = 1')}, s AS (SELECT avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS share FROM {_PTS}),
  r AS (SELECT ix, iy, round(g.n / t.n / share, 7) AS ratio, CASE WHEN g.n / t.n / share >= 1.5 THEN 1 ELSE 0 END + CASE WHEN g.n / t.n / share >= 3 THEN 1 ELSE 0 END AS level FROM t JOIN g USING (ix, iy), s WHERE t.n >= 0.02 * (SELECT max(n) FROM t)) SELECT ix, iy, ratio, level FROM r WHERE level > 0""")
def c23_relative_density(spark, sf_dir):
    return spatial.relative_density(points(spark, sf_dir), F.col("label") == 1, 0.5, 1.0)


#: Grid lines of a square by side: kind, and the crossing's place between the corners' values.
_SIDES = {
    "b": ("'h'", "sx", "sy", "sx + (level - v0) / (v1 - v0)", "sy"), "r": ("'v'", "sx + 1", "sy", "sx + 1", "sy + (level - v1) / (v2 - v1)"),
    "t": ("'h'", "sx", "sy + 1", "sx + (level - v3) / (v2 - v3)", "sy + 1"), "l": ("'v'", "sx", "sy", "sx", "sy + (level - v0) / (v3 - v0)"),
}


def _drawn() -> str:
    """One SELECT for each segment of each case of marching squares."""
    out = []
    for case, names in contours.CASES.items():
        for a, b in names.split():
            (ka, ia, ja, xa, ya), (kb, ib, jb, xb, yb) = _SIDES[a], _SIDES[b]
            ends = f"{ka} AS a_kind, {ia} AS a_i, {ja} AS a_j, {kb} AS b_kind, {ib} AS b_i, {jb} AS b_j"
            spots = f"round({xa} + 0.5, 6) AS ax, round({ya} + 0.5, 6) AS ay, round({xb} + 0.5, 6) AS bx, round({yb} + 0.5, 6) AS by_"
            out.append(f"SELECT label, level, sx, sy, {ends}, {spots} FROM cased WHERE shape = {case}")
    return " UNION ALL ".join(out)


@query(f"""WITH t AS {_blurred('true')}, lim AS (SELECT max(n) AS top, sum(n) AS sum_n FROM t), big AS (SELECT label FROM {_PTS} WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
  c AS (SELECT label, CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, count(*) AS n FROM {_PTS} JOIN big USING (label) GROUP BY 1, 2, 3), k AS (SELECT d, exp(-(d * d) / 2.0) AS w FROM (SELECT unnest(range(-3, 4)) AS d)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
  a AS (SELECT label, ix + d AS ix, iy, sum(n * w) AS n FROM c, kn GROUP BY 1, 2, 3), g AS (SELECT label, ix, iy + d AS iy, sum(n * w) AS n FROM a, kn GROUP BY 1, 2, 3), gw AS (SELECT label, sum(n) AS group_n FROM g GROUP BY 1),
  r AS (SELECT label, ix, iy, round((g.n / group_n) / (t.n / sum_n), 7) AS ratio FROM g JOIN t USING (ix, iy) JOIN gw USING (label), lim WHERE t.n > 0.02 * top),
  sq AS (SELECT label, ix - dx AS sx, iy - dy AS sy, coalesce(max(ratio) FILTER (k = 0), 0) AS v0, coalesce(max(ratio) FILTER (k = 1), 0) AS v1, coalesce(max(ratio) FILTER (k = 2), 0) AS v2, coalesce(max(ratio) FILTER (k = 3), 0) AS v3
    FROM r, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) o(k, dx, dy) GROUP BY 1, 2, 3),
  cased AS (SELECT *, m + CASE WHEN m IN (5, 10) AND (v0 + v1 + v2 + v3) / 4 >= level THEN 16 ELSE 0 END AS shape FROM (SELECT *, (v0 >= level)::INT + 2 * (v1 >= level)::INT + 4 * (v2 >= level)::INT + 8 * (v3 >= level)::INT AS m FROM sq, (VALUES (CAST(1.5 AS DOUBLE)), (CAST(3 AS DOUBLE))) l(level)))
  {_drawn()}""")
def c23_contour_segments(spark, sf_dir):
    grid = contours.ratio_grid(points(spark, sf_dir), "label", 0.5, 1.0, least=30)
    s = contours.segments(grid, ["label"], [1.5, 3.0])
    lines = [F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("kind", "i", "j")]
    return s.select("label", "level", "sx", "sy", *lines, *[F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by_")])


@query()
def c23_contours(spark, sf_dir):
    grid = contours.ratio_grid(points(spark, sf_dir), "label", 0.5, 1.0, least=30)
    return contours.polygons(contours.segments(grid, ["label"], [1.5, 3.0]), ["label"])


@query(f"""WITH q AS (SELECT id AS query_id, x AS qx, y AS qy FROM {_PTS} WHERE label = 0), d AS (SELECT query_id, id, round(sqrt(pow(x - qx, 2) + pow(y - qy, 2)), 7) AS distance FROM q, {_PTS} p WHERE label <> 0)
  SELECT query_id, id, distance FROM d WHERE distance < 1.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5""")
def j25_k_nearest_points(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.k_nearest(p.where("label = 0"), p.where("label <> 0"), 1.2, 5, digits=7).select("query_id", "id", "distance")


@query()
def c11_grid_clusters(spark, sf_dir):
    return spatial.grid_clusters(points(spark, sf_dir).select("id", "x", "y"), 0.5, 3)


@query()
def c11_density_tree(spark, sf_dir):
    return density_tree.clusters(density_tree.fit(points(spark, sf_dir).select("id", "x", "y"), 0.05, 10), 10)


@query()
def c12_tree_cuts(spark, sf_dir):
    return density_tree.level_cuts(density_tree.fit(points(spark, sf_dir).select("id", "x", "y"), 0.05, 5), 5, [60, 20, 5])


@query()
def c16_c27_hulls(spark, sf_dir):
    from ..functions.maths import polygon_area

    h = spatial.hulls(points(spark, sf_dir).select("id", "label", "x", "y"), "label")
    return h.select("label", "n", "cx", "cy", F.size("xs").alias("corners"), F.abs(polygon_area(F.col("xs"), F.col("ys"))).alias("area"))


@query()
def j28_v07_hull_overlaps(spark, sf_dir):
    h = spatial.hulls(points(spark, sf_dir).select("id", "label", "x", "y"), "label")
    return spatial.hull_pairs(h, "label", 2.0).withColumn("problem", F.col("overlap") > 0.5 * F.least("area_a", "area_b"))


@query()
def j27_nearest_hull(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "label", "x", "y")
    return spatial.nearest_polygons(p.select("id", "x", "y"), spatial.hulls(p, "label"), "label", 0.5)


@query(f"""WITH t AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}')) AS term FROM documents)), m AS (SELECT vec_id AS doc_id, label AS cluster FROM embeddings), tot AS (SELECT count(*) AS n FROM m),
  c AS (SELECT cluster, term, count(*) AS inside FROM t JOIN m USING (doc_id) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM t JOIN m USING (doc_id) GROUP BY 1), s AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1),
  r AS (SELECT cluster, term, inside, round((inside * 1.0 / df) * (inside * 1.0 / size) * ((inside * 1.0 / size) / (df * 1.0 / n)), 9) AS score FROM c JOIN d USING (term) JOIN s USING (cluster), tot WHERE inside >= 2)
  SELECT cluster, term, inside, score FROM r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) <= 8""")
def c13_cluster_terms(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    return terms.cluster_terms(terms.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", 3), m, 8)


@query()
def c13_hull_terms(spark, sf_dir):
    """Words and pairs for each label of the map, anchored at its middle and its outline."""
    p = points(spark, sf_dir).select("id", "label", "x", "y")
    hulls = spatial.hulls(p, "label").withColumnRenamed("label", "cluster")
    m = p.select(F.col("id").alias("doc_id"), F.col("label").alias("cluster"), "x", "y")
    return terms.hull_anchored_terms(terms.with_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 3), m, hulls, 8)


@query()
def c24_semantic_grid(spark, sf_dir):
    from ..operators.projection import semantic_grid

    return semantic_grid(points(spark, sf_dir), 0.5, 1.2, 30)


@query()
def c25_colour_raster(spark, sf_dir):
    from ..operators.projection import colour_raster

    return colour_raster(table(spark, sf_dir, "embeddings"), 0.05)


# Graphs


def tree(spark, sf_dir):
    """Supports: a customer's order supports the order halfway down its list; conflicts: neighbours of other stance."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("stance"))
    e = n.where("node % 5 <> 0").select(F.col("node").alias("child"), F.floor(F.col("node") / 5).cast("long").alias("parent"))
    return n, e.join(n.select(F.col("node").alias("parent")), "parent", "left_semi")


_TREE = "WITH RECURSIVE n AS (SELECT o_orderkey AS node, o_orderstatus AS stance FROM orders), e AS (SELECT node AS child, node // 5 AS parent FROM n WHERE node % 5 <> 0 AND node // 5 IN (SELECT node FROM n)), t(node, top, depth) AS (SELECT node, node, 0 FROM n WHERE node NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, t.top, t.depth + 1 FROM e JOIN t ON e.parent = t.node)"


@query(f"{_TREE} SELECT node, top, depth FROM t")
def c08_top_ancestors(spark, sf_dir):
    n, e = tree(spark, sf_dir)
    return graph.top_ancestors(e, n)


_CONF = f"{_TREE}, c AS (SELECT node AS id, node AS a, node + 1 AS b FROM n WHERE node % 7 = 1 AND node + 1 IN (SELECT node FROM n))"


def conflicts(spark, sf_dir):
    n, _ = tree(spark, sf_dir)
    c = n.where("node % 7 = 1").select(F.col("node").alias("id"), F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return c.join(n.select(F.col("node").alias("b")), "b", "left_semi").select("id", "a", "b")


@query(f"""{_CONF}, b AS (SELECT id, x.top AS pt, y.top AS ct FROM c JOIN t x ON x.node = a JOIN t y ON y.node = b), s AS (SELECT id, 0 AS side, pt AS top FROM b UNION ALL SELECT id, 1, ct FROM b)
  SELECT id AS band, CASE side WHEN 0 THEN 'pro' ELSE 'contra' END AS side, top, CASE WHEN row_number() OVER (PARTITION BY top ORDER BY id, side) = 1 THEN 'node' ELSE 'reference' END AS kind FROM s""")
def c08_w12_bands(spark, sf_dir):
    n, e = tree(spark, sf_dir)
    return graph.bands(conflicts(spark, sf_dir), graph.top_ancestors(e, n))


@query(f"""{_CONF}, b AS (SELECT x.top AS top FROM c JOIN t x ON x.node = a UNION SELECT y.top FROM c JOIN t y ON y.node = b) SELECT node, top FROM t WHERE top NOT IN (SELECT top FROM b)""")
def c08_loose_arguments(spark, sf_dir):
    n, e = tree(spark, sf_dir)
    tops = graph.top_ancestors(e, n)
    return graph.loose(n, tops, graph.bands(conflicts(spark, sf_dir), tops))


@query(f"{_TREE} SELECT top AS band, count(*) AS n, count(*) FILTER (stance = 'F') AS pro, count(*) FILTER (stance = 'O') AS contra, max(depth) AS depth FROM t JOIN n USING (node) GROUP BY 1")
def a33_tree_tallies(spark, sf_dir):
    n, e = tree(spark, sf_dir)
    k = lambda s: F.count(F.when(F.col("stance") == s, 1))
    return graph.top_ancestors(e, n).join(n, "node").groupBy(F.col("top").alias("band")).agg(F.count("*").alias("n"), k("F").alias("pro"), k("O").alias("contra"), F.max("depth").alias("depth"))


@query("""WITH n AS (SELECT o_orderkey AS node FROM orders), e AS (SELECT node AS child, node // 5 AS parent FROM n WHERE node % 5 <> 0 AND node // 5 IN (SELECT node FROM n)) SELECT n.node, (SELECT max(parent) FROM e WHERE child = n.node) AS parent, (SELECT count(*) FROM e WHERE parent = n.node) AS kids FROM n""")
def c09_tree_navigation(spark, sf_dir):
    n, e = tree(spark, sf_dir)
    kids = e.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    return n.select("node").join(e.select(F.col("child").alias("node"), "parent"), "node", "left").join(kids, "node", "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"))


@query(f"""{_CONF}, b AS (SELECT id, x.top AS pt, y.top AS ct FROM c JOIN t x ON x.node = a JOIN t y ON y.node = b), s AS (SELECT id, 0 AS side, pt AS top FROM b UNION ALL SELECT id, 1, ct FROM b),
  k AS (SELECT id AS band, CASE side WHEN 0 THEN 'pro' ELSE 'contra' END AS side, top, row_number() OVER (PARTITION BY top ORDER BY id, side) = 1 AS own FROM s), home AS (SELECT top, band AS ref_band FROM k WHERE own), ed AS (SELECT node AS child, node // 5 AS parent FROM n WHERE node % 5 <> 0 AND node // 5 IN (SELECT node FROM n))
  SELECT band AS scope, side, 0 AS place, top AS id, 'node' AS kind, CAST(NULL AS BIGINT) AS ref_band FROM k WHERE own UNION ALL SELECT band, side, row_number() OVER (PARTITION BY top ORDER BY child), child, 'kid', NULL FROM k JOIN ed ON ed.parent = top WHERE own
  UNION ALL SELECT band, side, 0, top, 'ref', ref_band FROM k JOIN home USING (top) WHERE NOT own UNION ALL SELECT NULL, CASE WHEN stance = 'F' THEN 'pro' ELSE 'contra' END, NULL, node, 'node', NULL FROM t JOIN n USING (node) WHERE top NOT IN (SELECT top FROM k)""")
def c09_list_entries(spark, sf_dir):
    n, e = tree(spark, sf_dir)
    tops = graph.top_ancestors(e, n)
    band = graph.bands(conflicts(spark, sf_dir), tops)
    side = F.when(F.col("stance") == "F", "pro").otherwise("contra").alias("side")
    return graph.list_entries(band, e, graph.loose(n, tops, band).join(n, "node").select("node", side))


@query(f"""{_CONF}, p AS (SELECT a AS node, b AS other FROM c UNION SELECT b, a FROM c) SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS partners FROM p GROUP BY 1""")
def c09_opposition_partners(spark, sf_dir):
    p = graph.opposition_partners(conflicts(spark, sf_dir))
    return p.select("node", F.array_join(F.transform("partners", lambda v: v.cast("string")), ",").alias("partners"))


@query(f"""WITH p AS {_PTS}, d AS (SELECT a.label, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, a.label = b.label AS same FROM p a JOIN p b ON b.id = a.id - a.id % 4 WHERE a.id % 4 <> 0)
  SELECT label, count(*) AS n, round(quantile_cont(d, 0.5), 7) AS median, round(quantile_cont(d, 0.9), 7) AS p90, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 9) AS same_cluster FROM d GROUP BY 1""")
def c32_map_metrics(spark, sf_dir):
    """Every fourth point is a source; the three behind it are its arguments."""
    p = points(spark, sf_dir)
    own = p.where("id % 4 <> 0").withColumn("source", F.col("id") - F.col("id") % 4)
    return similarity.map_metrics(own, p.where("id % 4 = 0"), "source", "label").select("label", "n", *[F.round(c, 7).alias(c) for c in ("median", "p90")], F.round("same_cluster", 9).alias("same_cluster"))


@query("""WITH n AS (SELECT o_orderkey AS node, o_orderstatus AS stance FROM orders), c AS (SELECT node AS id, node AS a, node + 1 AS b FROM n WHERE node % 7 = 1)
  SELECT id, a, b, CASE WHEN y.node IS NULL THEN 'unknown node' ELSE 'equal stances' END AS reason FROM c JOIN n x ON x.node = a LEFT JOIN n y ON y.node = b WHERE y.node IS NULL OR x.stance = y.stance""")
def v04_conflict_rules(spark, sf_dir):
    n, _ = tree(spark, sf_dir)
    c = n.where("node % 7 = 1").select(F.col("node").alias("id"), F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return graph.check_conflicts(c, n)


@query("""SELECT l_orderkey AS relation, CASE WHEN l_linenumber % 3 = 0 THEN 'checked' ELSE l_returnflag END AS scheme, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 ELSE CASE WHEN l_tax > 0.03 THEN 1.0 ELSE 0.0 END END >= 0.5""")
def v06_relation_checks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("relation"), "l_orderkey", "l_linenumber", "l_discount", "l_tax", F.col("l_returnflag").alias("scheme"))
    li = scratch(li, "relations")  # ids are read twice, so they are fixed first
    odd = F.col("l_linenumber") % 2 != 0
    checks = li.select("relation", F.when(~odd, F.col("l_discount") * 10).alias("strength"), (F.col("l_tax") > 0.03).cast("int").alias("legacy"), F.when(F.col("l_linenumber") % 3 == 0, "checked").alias("scheme"))
    kept = graph.keep_relations(li, checks, 0.5)
    return kept.select(F.col("l_orderkey").alias("relation"), "scheme", "l_linenumber")


@query("SELECT o_custkey AS grp, count(*) AS members FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) >= 2")
def v05_drop_small_groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("grp")).agg(F.count("*").alias("members")).where("members >= 2")
