"""Invariants and hand-made cases for what SQL on the tables does not show."""

import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from rostrum import catalog
from rostrum.functions import jsons, maths, temporal, text
from rostrum.operators import aggregates, contingency, facets, graph, intervals, merge, projection, relational, similarity, spans, spatial, terms, validation
from rostrum.plans import registry, texts


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("r")).first().r


# Text


@pytest.mark.parametrize(
    "fragment,quote,want",
    [
        (None, "a b c", "none"), ("  ", "a b c", "none"), ("b", "a b c", "valid"), ("x", "a b c", "not_found"), ("a", "a b a", "ambiguous"), ("aa", "aaa", "valid"),
        ("one ... three", "one two three", "valid_multipart"), ("one … nine", "one two three", "not_found"), ("(a) ... c.d", "(a) b c.d", "valid_multipart"), ("one ... two", "one x two. one y two", "ambiguous"),
    ],
)
def test_fragments(spark, fragment, quote, want):
    df = spark.createDataFrame([(fragment, quote)], "f string, q string")
    assert df.select(text.classify_fragment(F.col("f"), F.col("q")).alias("r")).first().r == want


def test_text_stats_of_empty_and_null(spark):
    df = spark.createDataFrame([("",), (None,), ("123 !!",), ("Hé. Wat leuk! Onbegrijpelijkheid",)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in text.text_stats(F.col("t")).items()]).collect()]
    assert got[:3] == [(0, 0, 0, 0, 0)] * 3
    assert got[3][:2] == (4, 3) and got[3][3] == 1


def test_small_text_functions(spark):
    df = spark.createDataFrame([("Crème Brûlée & Co", "org/model:fast", "https://v.nl/debat/begroting-2024-10-30/x", "Berg van den")], "a string, m string, u string, n string")
    m = text.split_provider(F.col("m"))
    r = df.select(text.slugify(F.col("a")).alias("slug"), m[0].alias("m"), m[1].alias("p"), text.debate_name(F.col("u")).alias("d"), text.name_order(F.col("n")).alias("n"), text.clock(F.lit(3725.9)).alias("c"), text.clock(F.lit(65)).alias("c2")).first()
    assert tuple(r) == ("creme-brulee-co", "org/model", "fast", "Begroting 2024", "van den Berg", "1:02:05", "1:05")


def test_fnv(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in registry.QUERIES["x12_fnv_ids"](spark, sf).collect():
        assert r.debate_id == texts.fnv_reference(pages[r.page_id])


def test_json_and_dates(spark):
    df = spark.createDataFrame([("```json\n{\"k\": 1,}\n```",), ("x {\"k\": 2} y",), ('{"k": ',), (None,)], "r string")
    assert [r.j and r.j.k for r in df.select(jsons.extract(F.col("r"), "k int").alias("j")).collect()] == [1, 2, None, None]
    df = spark.createDataFrame([("31-12-2020",), ("1/2/2021",), ("31.2.2021",), ("x",), (None,)], "r string")
    assert [str(r.d) for r in df.select(temporal.parse_day(F.col("r")).alias("d")).collect()] == ["2020-12-31", "2021-02-01", "None", "None", "None"]
    df = spark.createDataFrame([("2024-07-01 12:00:00",), ("2024-01-01 12:00:00",)], "t string").select(F.to_timestamp_ntz("t").alias("t"))
    assert [r.o for r in df.select(temporal.utc_offset(F.col("t")).alias("o")).collect()] == ["+02:00", "+01:00"]


def test_maths(spark):
    assert one(spark, maths.pct(F.lit(1), F.lit(8))) == 12.5 and one(spark, maths.pct(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, maths.nice_ceiling(F.lit(230.0))) == 250.0
    assert [tuple(spark.range(1).select(*maths.lab_to_rgb(F.lit(100.0), F.lit(0.0), F.lit(0.0))).first())] == [(255, 255, 255)]
    square = F.array(*map(F.lit, (0.0, 2.0, 2.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0)))
    assert one(spark, maths.polygon_area(*square)) == 4.0


# Facets


def test_facet_nulls_and_empty_selection(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, []), (3, "b", None)], "id int, s string, tags array<string>")
    q = facets.FacetQuery((facets.Dimension("s", F.col("s")), facets.Dimension("t", F.col("tags"), many=True)))
    ids = lambda sel: [r.id for r in df.where(q.predicate(sel)).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3] and ids({"s": ["a", "b"]}) == [1, 3] and ids({"t": ["x"], "s": ["a"]}) == [1] and ids({"t": ["y"]}) == []
    assert [r.id for r in df.where(facets.search(F.col("s"), "")).collect()] == [1, 2, 3]


# Intervals


def test_thinned_and_runs(spark):
    assert one(spark, intervals.thinned(F.array(*[F.lit(float(x)) for x in (0, 10, 46, 91, 92, 200)]), 46.0)) == [0.0, 46.0, 92.0, 200.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "g int, o int, v string")
    assert [(r.v, r.n) for r in intervals.runs(df, ["g"], "o", "v").orderBy("first").collect()] == [("a", 2), (None, 2), ("b", 1), ("a", 1)]


def test_nearest_ties_and_edges(spark):
    a = spark.createDataFrame([(1, "k", 100.0), (2, "k", 1000.0), (3, "z", 100.0)], "lid int, k string, t double")
    b = spark.createDataFrame([(9, "k", 110.0), (8, "k", 90.0), (7, "k", 1180.0)], "rid int, k string, t double")
    got = {r.lid: (r.nearest_id, r.distance) for r in intervals.nearest(a, b, ["k"], "t", "t", "lid", "rid", 180.0).collect()}
    assert got == {1: (8, 10.0), 2: (7, 180.0)}


def test_uncovered_day_is_a_hard_failure(spark):
    with pytest.raises(ValueError):
        validation.require_none(spark.createDataFrame([("2000-01-01",)], "day string"), "no period")
    validation.require_none(spark.createDataFrame([], "day string"), "no period")


def test_span_algebra(spark):
    s = lambda *p: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in p])
    r = spark.range(1).select(*[c.alias(n) for n, c in zip("pqr", spans.char_outcomes(s((0, 5), (3, 8), (20, 25)), s((4, 10))), strict=True)]).first()
    assert tuple(r) == (4, 9, 2)


# Changes


def test_reseed_is_idempotent_and_keeps_history(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "k string, v int, active boolean")
    new = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    once = merge.reseed(old, new, ["k"], "active")
    want = [("a", 1, False), ("b", 2, True), ("c", 3, True)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, merge.reseed(once, new, ["k"], "active").collect()))


def test_get_or_create_null_keys(spark):
    dim = spark.createDataFrame([(1, "x", None)], "id long, name string, party string")
    want = spark.createDataFrame([("x", None), ("y", None), ("x", "p"), ("x", None)], "name string, party string")
    got = sorted((tuple(r) for r in merge.get_or_create(dim, want, ["name", "party"], "id").collect()), key=repr)
    assert got == [(1, "x", None), (2, "x", "p"), (3, "y", None)]


def test_overrides_must_be_known(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        validation.override(df, spark.createDataFrame([(2, "b")], "k int, v string"), "k", "v")


# Contingency


def test_correspondence_identities():
    rng = np.random.default_rng(0)
    m = rng.integers(1, 40, (7, 5))
    ca = contingency.correspondence(m, list("abcdefg"), list("vwxyz"))
    assert np.abs(ca.row_mass @ ca.row_coords).max() < 1e-12 and np.abs(ca.col_mass @ ca.col_coords).max() < 1e-12
    p = m / m.sum()
    e = np.outer(ca.row_mass, ca.col_mass)
    back = e * (1 + ca.row_coords / np.sqrt(((ca.row_coords**2) * ca.row_mass[:, None]).sum(axis=0)) @ ca.col_coords.T)
    assert np.abs(back - p).max() < 1e-10 and abs(ca.inertia.sum() - 1) < 1e-12
    order = [3, 1, 0, 2, 6, 5, 4]
    again = contingency.correspondence(m[order], [list("abcdefg")[i] for i in order], list("vwxyz"))
    assert np.abs(again.row_coords - ca.row_coords[order]).max() < 1e-9
    assert contingency.correspondence(m[:2], list("ab"), list("vwxyz")) is None
    assert (contingency.align(-ca.row_coords, ca.row_coords) == -1).all()


def test_agreement_bounds(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) * 2) for i in range(30)], "a int, b int")
    r = aggregates.agreement(df, "a", "b").first()
    assert abs(r.ari - 1) < 1e-9 and abs(r.nmi - 1) < 1e-9


# Vectors and space


def test_medoid_and_centroid(spark):
    v = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, [0.5, 0.5])]
    df = spark.createDataFrame(v, "vec_id long, label int, embedding array<double>")
    assert [r.vec_id for r in similarity.medoids(df, "label", 1).collect()] == [2]


def test_linkage(spark):
    v = [(1, 0, [1.0, 0.0, 0.0, 0.0]), (2, 0, [0.99, 0.01, 0.0, 0.0]), (3, 0, [0.0, 1.0, 0.0, 0.0]), (4, 1, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: r.cluster for r in projection.linkage(df, "label", "vec_id", "embedding", 0.2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_linkage_in_rounds_equals_one_task(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8))
    v = [(i, i % 2 if i % 5 else None, [float(x) for x in centres[i % 12] + 0.4 * rng.standard_normal(8)]) for i in range(240)]
    df = spark.createDataFrame(v, "vec_id long, label int, embedding array<double>")
    one, rounds = ({(r.label, r.vec_id): r.cluster for r in projection.linkage(df, "label", "vec_id", "embedding", 0.4, block=b).collect()} for b in (2000, 30))
    assert len(one) == 240 and one == rounds and 12 <= len({(k[0], c) for k, c in one.items()}) < 120


def test_linkage_of_copies_takes_few_rounds(spark, monkeypatch):
    from rostrum import session

    steps = []
    monkeypatch.setattr(projection, "scratch", lambda df, tag: steps.append(tag) or session.scratch(df, tag))
    v = [(i, 0, [1.0, 0.0]) for i in range(40)] + [(40, 0, [0.9, 0.1]), (41, 0, [0.0, 1.0])] + [(i, 0, [0.0, 0.0]) for i in (42, 43)]
    df = spark.createDataFrame(v, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r.cluster for r in projection.linkage(df, "label", "vec_id", "embedding", 0.2, block=1).collect()}
    assert got == {i: 0 for i in range(41)} | {41: 41, 42: 42, 43: 43}
    assert len(steps) < 30  # the copies do not merge one a round


def test_survivors_equal_brute_force(spark):
    p = cloud(spark, 400)
    shown = spatial.thin(p, [4], 1, -12.0, 12.0, F.lit(1.0)).where("x < 0 OR rank % 7 = 0")
    got = {r.id: r.point_count for r in spatial.survivors(shown, p, 4, -12.0, 12.0).collect()}
    pts = {r.id: (r.x, r.y) for r in p.collect()}
    keep = sorted(r.id for r in shown.collect())
    want = {}
    for x, y in pts.values():
        best = min(keep, key=lambda k: ((pts[k][0] - x) ** 2 + (pts[k][1] - y) ** 2, k))
        want[best] = want.get(best, 0) + 1
    assert got == want and sum(got.values()) == len(pts)


def test_dense_ids_follow_the_order(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 37) % 1009 END AS a")
    order = [F.col("a").asc_nulls_first(), F.col("id").asc()]
    got = [(r.a, r.id) for r in relational.dense_ids(df, order, "at").orderBy("at").collect()]
    assert got == sorted(((r.a, r.id) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(r["at"] for r in relational.dense_ids(df, order, "at").collect()) == list(range(5000))


def cloud(spark, n=2000):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 3, (n, 2)), rng.normal(4, 0.4, (n // 4, 2))])
    return spark.createDataFrame([(i, float(x), float(y), int(i >= n)) for i, (x, y) in enumerate(p)], "id long, x double, y double, g int")


def test_thinning_is_monotone_and_ranks_are_dense(spark):
    p = cloud(spark)
    ranks = sorted(r["rank"] for r in spatial.ranked(p, F.lit(1.0), buckets=16).collect())
    assert ranks == list(range(1, len(ranks) + 1))
    shown = spatial.thin(p, [0, 1, 2, 3], 50, -12.0, 12.0, F.lit(1.0))
    by = {}
    for r in shown.collect():
        by.setdefault(r.z, set()).add(r.id)
    assert by[0] <= by[1] <= by[2] <= by[3] and len(by[0]) == 50
    counts = spatial.survivors(shown, p.select("id", "x", "y"), 2, -12.0, 12.0).collect()
    assert sum(c.point_count for c in counts) <= p.count()


def test_relative_density_levels_nest(spark):
    r = spatial.relative_density(cloud(spark), F.col("g") == 1, 0.5, 1.0).collect()
    assert any(x.level == 2 for x in r) and all(x.ratio >= (1.5 if x.level == 1 else 3.0) - 1e-6 for x in r)


def test_blur_keeps_mass_and_sample_interpolates(spark):
    g = spark.createDataFrame([(0, 0, 10), (5, 5, 4)], "ix long, iy long, n long")
    assert abs(spatial.blur(g, 1.0).agg(F.sum("n")).first()[0] - 14) < 1e-9
    grid = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (0, 1, 1.0), (1, 1, 3.0)], "ix long, iy long, value double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5)], "id long, x double, y double")
    assert {r.id: r.value for r in spatial.sample(pts, grid, 1.0).collect()} == {1: 2.0, 2: 1.0}


def test_grid_clusters_and_hulls(spark):
    rows = [(i, 0.1 * (i % 10), 0.1 * (i // 10)) for i in range(100)] + [(100 + i, 9 + 0.1 * (i % 10), 0.1 * (i // 10)) for i in range(100)] + [(999, 5.0, 5.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    c = {r.id: r.cluster for r in spatial.grid_clusters(p, 0.5, 3).collect()}
    assert c[999] == -1 and len({c[i] for i in range(100)}) == 1 and c[0] != c[100]
    h = spatial.hulls(p.where("id < 999").withColumn("g", (F.col("id") >= 100).cast("int")), "g", keep=1.0).orderBy("g").collect()
    assert [len(x.xs) for x in h] == [4, 4] and spatial.contains(0.5, 0.5, h[0].xs, h[0].ys) and not spatial.contains(5, 5, h[0].xs, h[0].ys)
    a = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert abs(spatial.clip_area(a, a + 1) - 1) < 1e-12 and spatial.clip_area(a, a + 5) == 0


def test_pca_against_svd(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: (r.x0, r.x1) for r in projection.pca(e, "vec_id", "embedding", 2).collect()}
    rows = e.orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    _, _, vt = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    want = v @ vt[:2].T
    have = np.array([got[r.vec_id] for r in rows])
    assert np.abs(np.abs(have) - np.abs(want)).max() < 1e-6


# Graphs


def test_cycle_is_an_error_and_deep_chain_settles(spark):
    n = spark.createDataFrame([(i,) for i in range(100)], "node long")
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 100)], "child long, parent long")
    top = {r.node: (r.top, r.depth) for r in graph.top_ancestors(chain, n).collect()}
    assert top == {i: (0, i) for i in range(100)}
    with pytest.raises(ValueError):
        graph.top_ancestors(spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), n.where("node in (1, 2)"), limit=6)


def test_small_counts_and_lookup(spark):
    df = spark.createDataFrame([("a", 9), ("b", 1), ("c", 2)], "k string, n long")
    assert sorted(map(tuple, relational.small_counts(df, "k", "n", 3, "rest").collect())) == [("a", 9), ("rest", 3)]


def test_token_counts(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from rostrum.functions.tokens import token_counter

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    data = ["", None, "Hallo wereld, it's fine", "a  b\n\nc", "é" * 50]
    count = token_counter(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    df = spark.createDataFrame(list(enumerate(data)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", count("t").alias("n")).collect()}
    assert got == {i: len(t.encode(x or "").ids) for i, x in enumerate(data)}


def test_token_counts_hold_one_text_at_a_time():
    """A batch of many texts takes little more memory than one of few: no list of them, or of a text's ids, is built."""
    import tracemalloc

    import public_tokenizers as p
    import pyarrow as pa

    from rostrum.functions.tokens import token_counter

    count = token_counter(p.path("byte_bpe_50k.tiktoken"), p.PATTERN).func
    few = count(pa.array(["one two <|endoftext|> " * 2000, None, ""]))
    texts = pa.array(["one two <|endoftext|> " * 2000] * 100, pa.string())
    tracemalloc.start()
    got = count(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(map(int, got)) == [int(few[0])] * 100 and [int(x) for x in few[1:]] == [0, 0]
    assert peak < 500_000  # 44 kB a text


def test_smooth_ring_passes_through_the_corners_of_a_regular_ring():
    a = np.arange(6) * np.pi / 3
    ring = np.column_stack([np.cos(a), np.sin(a)])
    got = spatial.smooth_ring(ring, 60)
    assert np.allclose(got[::10], ring, atol=1e-4)
    assert np.abs(np.linalg.norm(got, axis=1) - 1).max() < 0.01  # straight edges come as near as 0.87
    assert np.allclose(spatial.smooth_ring(np.vstack([ring, ring[:1]]), 60), got)
    assert len(spatial.smooth_ring(ring[:3])) == 3


def test_smooth_hulls_keep_every_hull(spark, sf):
    from rostrum.plans.registry import QUERIES

    hulls, smooth = QUERIES["c16_c27_hulls"](spark, sf), QUERIES["c26_smooth_hulls"](spark, sf)
    corners = {r.label: r.corners for r in hulls.collect()}
    assert {r.label: len(r.xs) for r in smooth.collect()} == {k: 60 if n > 3 else n for k, n in corners.items()}


def test_text_stats_equal_a_walk_over_the_words(spark):
    vowels = "aeiouyàáâäèéêëìíîïòóôöùúûü"
    texts = ["", None, "...", "Dr. Brr, psst! Strength?  Één  ÉÉN één.", "a.b c!?d\n", "xyz. 12. ...\n\nRhythms; ryhthm’s ok", "Über-lange Wörterbücher", "e.\n", "?! \nA"]

    def walk(t):
        t = t or ""
        w = regex.findall(r"\p{L}+", t)
        runs = [len(regex.findall(f"[{vowels}]+", x.lower())) for x in w]
        pieces = [x for x in regex.split(r"[.!?]+(?:\s+|$)", t) if regex.search(r"\p{L}", x)]
        return len(w), len(pieces), sum(max(1, r) for r in runs), sum(len(x) > 6 for x in w), len({x.lower() for x in w})

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", *[c.alias(k) for k, c in text.text_stats(F.col("t")).items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [walk(t) for t in texts]


def test_sentences_in_time_linear_in_the_marks(spark):
    """A run of a million dots, as in a table of contents, is read once."""
    rows = [("a" + "." * 1_000_000 + "b",), ("a" + "." * 1_000_000 + " b",), ("Ja. Nee?! 3.5 meer... en. ",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    n = text.text_stats(F.col("t"))["sentence_count"]
    start = time.monotonic()
    assert [r.n for r in df.select(n.alias("n")).collect()] == [1, 2, 4, 0, 0]
    assert time.monotonic() - start < 20


def test_spread_moves_small_tables_only(spark):
    one = spark.range(10).coalesce(1)
    assert catalog.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 9)
    assert catalog.spread(many) is many


def test_fnv_over_utf16_units(spark):
    words = ["", "a", "é", "日本", "🙂 x", "ÿ" * 300]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.fnv1a36(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {w: texts.fnv_reference(w) for w in words}


def test_contrast_of_mean_weights(spark):
    w = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.5), (3, "b", 1.0), (4, "c", 1.0), (9, "a", 1.0)], "doc_id int, term string, weight double")
    m = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "y", "p"), (5, "y", "p"), (4, "z", "q"), (9, None, "p")], "doc_id int, child string, parent string")
    got = {(r.child, r.term): r.contrast for r in terms.contrast_weights(w, m, 5).collect()}
    # a: 1.5 / 2 in x, 1.5 / 4 in p; b: 0.5 / 2 in x and 1 / 2 in y, 1.5 / 4 in p; c: the same in z and q.
    assert got == {("x", "a"): 0.375, ("y", "b"): 0.125}


def test_nearest_polygons_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    polys = {}
    for k in range(12):
        c, n, r = rng.uniform(-20, 20, 2), rng.integers(3, 9), rng.uniform(0.2, 6)
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        polys[f"p{k:02d}"] = np.c_[c[0] + r * np.cos(a), c[1] + r * np.sin(a)]
    polys["point"], polys["line"], polys["far"] = np.array([[3.0, 3.0]]), np.array([[0.0, 30.0], [9.0, 30.0]]), np.array([[900.0, 900.0], [901.0, 900.0], [900.0, 901.0]])
    polys["z-same"] = polys["p00"]
    pts = np.concatenate([rng.uniform(-30, 30, (300, 2)), [[3.0, 3.0], [500.0, 500.0], [-4000.0, 0.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(998, None, 1.0), (999, float("nan"), 1.0)], "id long, x double, y double")
    shapes = spark.createDataFrame([(k, v[:, 0].tolist(), v[:, 1].tolist()) for k, v in polys.items()] + [("none", [], [])], "name string, xs array<double>, ys array<double>")
    got = {r.id: (r.name, r.distance) for r in spatial.nearest_polygons(df, shapes, "name", 0.5).collect()}
    assert got.pop(998) == got.pop(999) == (None, None) and len(got) == len(pts)
    for i, p in enumerate(pts):
        best = []
        for k, v in sorted(polys.items()):
            e = np.roll(v, -1, axis=0) - v
            t = np.clip(((p - v) * e).sum(axis=1) / np.maximum((e * e).sum(axis=1), 1e-12), 0, 1)
            d = float(np.sqrt(((v + t[:, None] * e - p) ** 2).sum(axis=1).min()))
            best.append((0.0 if spatial.contains(*p, v[:, 0], v[:, 1]) else d, k))
        want = min(best)
        assert abs(got[i][1] - want[0]) < 1e-9 and (got[i][0] == want[1] or any(k == got[i][0] and abs(d - want[0]) < 1e-12 for d, k in best))
    assert {r.name for r in spatial.nearest_polygons(df.where("id < 5"), shapes.where("name = 'none'"), "name", 0.5).collect()} == {None}
    assert spatial.nearest_polygons(df.where("id < 0"), shapes, "name", 0.5).count() == 0


def test_hull_anchored_terms_equal_the_definition(spark):
    rng = np.random.default_rng(6)
    places = {i: (("a", "b", "c")[i % 3], *rng.normal((8 * (i % 3), 0), 1.0)) for i in range(90)} | {100: ("tiny", 50.0, 50.0), 101: ("tiny", 50.0, 51.0)}
    vocab = [f"w{k}" for k in range(25)]
    words = {i: {vocab[int(k)] for k in rng.integers(0, 25, 4)} | {f"own-{c}"} for i, (c, _, _) in places.items()} | {500: {"w1"}}
    words[100], words[101] = {"x", "only"}, {"x"}
    for i in list(places)[:90]:  # a word of the middle documents only
        if abs(places[i][1] - 8 * (i % 3)) + abs(places[i][2]) < 0.5:
            words[i].add("middle")
    members = spark.createDataFrame([(i, c, float(x), float(y)) for i, (c, x, y) in places.items()], "doc_id long, cluster string, x double, y double")
    toks = spark.createDataFrame([(i, w) for i, ws in words.items() for w in ws] + [(0, sorted(words[0])[0])], "id long, term string")
    hulls = spatial.hulls(members.withColumnRenamed("cluster", "label").withColumnRenamed("doc_id", "id"), "label").withColumnRenamed("label", "cluster")
    base = spark.createDataFrame([("a", "own-a", 0.05), ("a", "w1", 3.0)], "cluster string, term string, weight double")
    shape = {r.cluster: r for r in hulls.collect()}
    spread = lambda ids: float(np.sqrt(np.var([places[i][1] for i in ids]) + np.var([places[i][2] for i in ids])))
    for weights in (None, base):
        got = {}
        for r in terms.hull_anchored_terms(toks, members, hulls, 40, weights).collect():
            got.setdefault(r.cluster, {})[r.term] = (r.inside, r.score)
        boost = {} if weights is None else {(r.cluster, r.term): r.weight for r in base.collect()}
        for c in ("a", "b", "c", "tiny"):
            own = [i for i, p in places.items() if p[0] == c]
            h = shape[c]
            near = sorted(own, key=lambda i: ((places[i][1] - h.cx) ** 2 + (places[i][2] - h.cy) ** 2, i))[:5]
            corner = {min(i for i in own if places[i][1:] == (x, y)) for x, y in zip(h.xs, h.ys, strict=True)} if len(h.xs) >= 3 else set()
            reps = set(near) | corner
            least = 2 if len(own) < 25 else max(3, int(len(own) * 0.02))
            want = {}
            for t in {w for i in own for w in words[i]}:
                inside, rep, every = (sum(t in words[i] for i in ids) for ids in (own, reps, places))
                if inside < 2:
                    continue
                rung = 0 if inside >= least and rep else 1 if inside >= least else 2
                compact = max(0.01, 1 - spread([i for i in places if t in words[i]]) / spread(list(places)))
                contrast = 1.0 if weights is None else max(0.1, boost.get((c, t), 0.0))
                want[t] = (rung, inside, compact * inside / every * inside / len(own) * contrast * (1 + 2 * rep / len(reps)))
            best = min(r for r, _, _ in want.values())
            want = {t: (n, pytest.approx(s, abs=1e-8)) for t, (r, n, s) in want.items() if r == best}
            assert got[c] == want
