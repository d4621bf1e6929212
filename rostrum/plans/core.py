"""Filters, joins, aggregates and rankings on the driver tables.

Stand-ins: an order is an argument (status: stance, priority: typology), its customer the speaker,
the nation the party, a line item a tag assignment (part brand: tag, part type: tag group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.maths import pct, ratio
from ..operators import aggregates as agg
from ..operators import facets, relational
from .registry import query

#: SQL of the two joins that most statements share.
ARG = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
TAG = f"{ARG} JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    a = arguments(spark, sf_dir)
    return a.join(li, a.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)


def _pct(n, t):
    return f"CASE WHEN {t} = 0 THEN 0.0 ELSE floor(1000.0 * ({n}) / ({t}) + 0.5) / 10 END"


_STANCE = ", ".join(f"count(*) FILTER (o_orderstatus = '{k}') AS {v}" for k, v in agg.STANCES.items())
_STANCE_PCT = ", ".join(f"floor(1000.0 * count(*) FILTER (o_orderstatus = '{k}') / count(*) + 0.5) / 10 AS {v}_pct" for k, v in agg.STANCES.items())


# Filters


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P' ")
def f01_export_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query(
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT')
    AND o_orderkey >= 10 AND o_orderdate >= TIMESTAMP '1996-06-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200"""
)
def f02_pending_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q = relational.pending(
        o, F.col("o_orderstatus") == "O", ~F.col("o_orderpriority").isin("1-URGENT"), F.col("o_orderkey") >= 10,
        F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz"), order=[F.desc("o_orderdate"), F.col("o_orderkey")], limit=200,
    )
    return q.select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def f03_untagged_by_ids(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return relational.pending(o, F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13, 21, 34), done=li, on="o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_discount > 0.08)")
def f04_semi_join_queue(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_discount > 0.08")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def f05_anti_join_queue(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND (nullif(lang, 'fr') IS NULL OR lang IN ('en', 'de')) AND source <> 'src0'""")
def f06_null_or_in_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.nullif(F.col("lang"), F.lit("fr"))
    return d.where((F.col("n_chars") >= 200) & relational.kind_in(kind, ["en", "de"], null_ok=True) & (F.col("source") != "src0")).select("doc_id", "n_chars")


@query("""SELECT doc_id, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(text, '^[^ ]+ ', '') AS t FROM documents) WHERE length(t) >= 150""")
def f07_filter_after_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "^[^ ]+ ", "").alias("t"))
    return d.where(F.length("t") >= 150).select("doc_id", F.length("t").cast("long").alias("n"))


@query("SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars FROM conversations WHERE role <> 'system' AND text IS NOT NULL AND text <> ''")
def f08_turn_denominator(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.where("role <> 'system' AND text <> ''").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


def facet_query() -> facets.FacetQuery:
    return facets.FacetQuery(
        (
            facets.Dimension("stance", F.col("o_orderstatus")),
            facets.Dimension("typology", F.col("o_orderpriority")),
            facets.Dimension("party", F.col("n_name")),
            facets.Dimension("role", F.col("c_mktsegment")),
            facets.Dimension("tag", F.col("tags"), many=True),
        )
    )


def faceted(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    tags = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("tags"))
    a = arguments(spark, sf_dir)
    return a.join(tags, a.o_orderkey == tags.l_orderkey, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


SELECTION = {"stance": ["F", "O"], "role": ["BUILDING", "MACHINERY"], "tag": ["RF", "AO"]}
_FACETED = f"""(SELECT o.*, coalesce(tags, CAST([] AS VARCHAR[])) AS tags FROM (SELECT * FROM {ARG}) o LEFT JOIN
  (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS tags FROM lineitem GROUP BY 1) t ON o_orderkey = l_orderkey)"""
_S, _R, _T = "o_orderstatus IN ('F','O')", "c_mktsegment IN ('BUILDING','MACHINERY')", "list_has_any(tags, ['RF','AO'])"


@query(f"SELECT o_orderkey, n_name FROM {_FACETED} WHERE {_S} AND {_R} AND {_T}")
def f09_faceted_filter(spark, sf_dir):
    return faceted(spark, sf_dir).where(facet_query().predicate(SELECTION)).select("o_orderkey", "n_name")


@query(f"SELECT o_orderkey, o_orderstatus FROM {_FACETED} WHERE {_R} AND {_T}")
def f10_facet_skip_dimension(spark, sf_dir):
    return faceted(spark, sf_dir).where(facet_query().predicate(SELECTION, {"stance"})).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d FROM orders)
    WHERE d BETWEEN DATE '1996-02-01' AND DATE '1996-04-30'""")
def f11_date_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return o.where(facets.date_range(day, "1996-02-01", "1996-04-30")).select("o_orderkey")


@query("SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'ete') AND contains(strip_accents(lower(text)), 'que')")
def f12_free_text_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(facets.search(F.col("text"), "Été QUE")).select("doc_id", "lang")


@query("""SELECT * FROM (VALUES ('stance','F'),('stance','X'),('role','BUILDING'),('role','NOBODY'),('tag','RF')) v(facet, value)
    WHERE (facet, value) IN (SELECT 'stance', o_orderstatus FROM orders UNION SELECT 'role', c_mktsegment FROM customer UNION SELECT 'tag', l_returnflag || l_linestatus FROM lineitem)""")
def f13_validate_selection(spark, sf_dir):
    chosen = {"stance": ["F", "X"], "role": ["BUILDING", "NOBODY"], "tag": ["RF"]}
    return facet_query().valid(faceted(spark, sf_dir), chosen)


@query(
    r"""WITH t AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN CAST(regexp_matches(lower(text), '\bthe\b') AS INT) END) AS title FROM conversations GROUP BY 1)
    SELECT c.conv_id, c.turn FROM conversations c JOIN t USING (conv_id)
    WHERE coalesce(title = 1, false) OR regexp_matches(lower(c.text), '\b(of|and)\b')"""
)
def f14_two_tier_topic_match(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    title = c.where("turn = 0").groupBy("conv_id").agg(F.max(F.lower("text").rlike(r"\bthe\b")).alias("title"))
    return c.join(title, "conv_id", "left").where(F.coalesce("title", F.lit(False)) | F.lower("text").rlike(r"\b(of|and)\b")).select("conv_id", "turn")


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%a%') AND NOT lower(p_name) LIKE '%7%'")
def f15_title_include_exclude(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(relational.title_predicate(F.col("p_type"), ["BRASS", "steel", "a"]) & ~F.lower("p_name").contains("7")).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'de') IS DISTINCT FROM 'en'")
def f16_null_safe_inequality(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~F.nullif(F.col("lang"), F.lit("de")).eqNullSafe(F.lit("en"))).select("doc_id")


@query(r"""SELECT doc_id, regexp_extract(text, '(?i)(stupid|idiot|moron|[a-z]+ble and [a-z]+)', 1) AS hit FROM documents WHERE regexp_matches(text, '(?i)(stupid|idiot|moron|[a-z]+ble and [a-z]+)')""")
def f17_regex_candidates(spark, sf_dir):
    p = r"(?i)(stupid|idiot|moron|[a-z]+ble and [a-z]+)"
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("hit"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE isfinite(embedding[1]) AND isfinite(embedding[2])")
def f18_finite_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    ok = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return e.where(ok("x") & ok("y"))


def nested_arguments(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("group"))
    tags = li.distinct().groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("key", "group"))).alias("tags"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(tags, "o_orderkey", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<key:string,group:string>>")))


@query("""SELECT o_orderkey, count(*) AS n_tags FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1""")
def f19_keep_only_tag(spark, sf_dir):
    a = nested_arguments(spark, sf_dir).where(F.exists("tags", lambda t: t["key"] == "N"))
    return a.select("o_orderkey", F.size(facets.keep_tag(F.col("tags"), "N")).cast("long").alias("n_tags"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_tags FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey""")
def f20_perspective_scope(spark, sf_dir):
    return nested_arguments(spark, sf_dir).select("o_orderkey", F.size(facets.scope_tags(F.col("tags"), "group", "F")).cast("long").alias("n_tags"))


@query("""SELECT o_custkey AS debate, max(o_orderdate) AS last_seen FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey
    WHERE o_custkey NOT IN (1, 2, 3) GROUP BY 1 HAVING bool_or(l_orderkey IS NOT NULL) AND bool_or(o_orderstatus = 'F')""")
def f21_quality_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(~F.col("o_custkey").isin(1, 2, 3))
    tags = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    g = o.join(tags, o.o_orderkey == tags.l_orderkey, "left").groupBy(F.col("o_custkey").alias("debate")).agg(
        F.max("o_orderdate").alias("last_seen"), F.bool_or(F.col("l_orderkey").isNotNull()).alias("t"), F.bool_or(F.col("o_orderstatus") == "F").alias("p")
    )
    return g.where("t AND p").select("debate", "last_seen")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels) ORDER BY item_id LIMIT 20")
def f22_unevaluated(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    return relational.pending(b, done=d, on="item_id", order=[F.col("item_id")], limit=20).select("item_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def f23_seeded_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(100).select("doc_id")


@query("SELECT vec_id, label // 3 AS parent FROM embeddings WHERE label // 3 = 1 OR label = 9")
def f24_cluster_selection(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("parent", F.floor(F.col("label") / 3).cast("int"))
    return e.where("parent = 1 OR label = 9").select("vec_id", "parent")


# Joins


@query(f"SELECT o_orderkey, c_name, n_name, o_orderstatus FROM {ARG}")
def j01_three_way(spark, sf_dir):
    return arguments(spark, sf_dir).select("o_orderkey", "c_name", "n_name", "o_orderstatus")


@query(f"SELECT o_orderkey, p_brand, p_type FROM {TAG} WHERE p_size >= 25")
def j02_bridge_active_only(spark, sf_dir):
    return tagged(spark, sf_dir).where("p_size >= 25").select("o_orderkey", "p_brand", "p_type")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j03_claims(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT n_name AS party, p_brand AS tag, count(*) AS n FROM {TAG} WHERE l_returnflag = 'R' GROUP BY 1, 2")
def j04_party_tag_counts(spark, sf_dir):
    return tagged(spark, sf_dir).where("l_returnflag = 'R'").groupBy(F.col("n_name").alias("party"), F.col("p_brand").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'Onbekend') AS topic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j05_left_with_default(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("Onbekend")).alias("topic"))


@query(f"""SELECT o_orderkey, unnest(list_filter([CASE WHEN n_regionkey = 1 THEN 'region-one' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS tag FROM {ARG}""")
def j06_c07_derived_tags(spark, sf_dir):
    rules = [(F.col("n_regionkey") == 1, "region-one"), (F.col("c_mktsegment") == "BUILDING", "builder"), (F.col("o_orderpriority") == "1-URGENT", "urgent")]
    tags = F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))
    return arguments(spark, sf_dir).select("o_orderkey", F.explode(tags).alias("tag"))


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || CAST(l_quantity AS INT), ',' ORDER BY l_linenumber, l_quantity, l_partkey), '') AS claims, count(l_orderkey) AS n FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_discount >= 0.07) ON o_orderkey = l_orderkey GROUP BY 1""")
def j07_nest_children(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_discount >= 0.07").withColumnRenamed("l_orderkey", "o_orderkey")
    n = relational.nest(o, li, "o_orderkey", "claims", ["l_linenumber", "l_quantity", "l_partkey"], ["l_linenumber", "l_quantity", "l_partkey"])
    text = F.array_join(F.transform("claims", lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["l_quantity"].cast("int").cast("string"))), ",")
    return n.select("o_orderkey", text.alias("claims"), F.size("claims").cast("long").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def j08_semi(spark, sf_dir):
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return s.join(li, s.s_suppkey == li.l_suppkey, "left_semi").select("s_suppkey", "s_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10)")
def j09_anti(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_quantity > 10")
    return p.join(li, p.p_partkey == li.l_partkey, "left_anti").select("p_partkey")


@query("""SELECT c_custkey, coalesce(a.v, b.v, 'reference') AS party FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey""")
def j21_layered_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    layers = [o.where("o_orderstatus = 'P'"), o]
    layers = [x.groupBy("c_custkey").agg(F.min("o_orderpriority").alias("party")) for x in layers]
    out = relational.layered_lookup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", layers, "party")
    return out.withColumn("party", F.coalesce("party", F.lit("reference")))


@query("""WITH c AS (SELECT l_suppkey AS child, p_brand AS parent, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT child, parent, n FROM c QUALIFY row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) = 1""")
def j23_majority_parent(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    c = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("child"), F.col("p_brand").alias("parent")).agg(F.count("*").alias("n"))
    return relational.best_per_group(c, ["child"], [F.desc("n"), F.col("parent")])


@query("SELECT e.vec_id, coalesce(l.quality, -1) AS cluster FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def j31_label_propagation(spark, sf_dir):
    e, lab = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    return e.join(lab, e.vec_id == lab.doc_id, "left").select("vec_id", F.coalesce("quality", F.lit(-1)).alias("cluster"))


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def j32_curated_over_computed(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("label"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j33_dictionary_decode(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT DISTINCT o_orderkey, l_suppkey, s_nationkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = o_orderkey)")
def j34_chained_lookup(spark, sf_dir):
    o, li, s = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    have = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"))
    return o.join(have, "o_orderkey", "left_anti").join(li, F.col("o_orderkey") == li.l_orderkey).join(s, li.l_suppkey == s.s_suppkey).select("o_orderkey", "l_suppkey", "s_nationkey").distinct()


# Aggregates


@query(f"SELECT count(*) AS total, {_STANCE}, {_STANCE_PCT} FROM orders")
def a01_stance_counts(spark, sf_dir):
    return agg.stance_counts(table(spark, sf_dir, "orders"), "o_orderstatus", [])


@query(f"SELECT d.o_orderpriority, count(o_orderkey) AS total, {_STANCE} FROM (VALUES ('1-URGENT'),('2-HIGH'),('3-MEDIUM'),('4-NOT SPECIFIED'),('5-LOW'),('6-NONE')) d(o_orderpriority) LEFT JOIN orders o ON o.o_orderpriority = d.o_orderpriority GROUP BY 1")
def a02_typology_matrix(spark, sf_dir):
    dom = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
    return agg.typology_matrix(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", dom)


@query(f"SELECT n_name AS party, count(*) AS total, {_STANCE}, {_STANCE_PCT} FROM {ARG} GROUP BY 1")
def a03_stance_stats_by_party(spark, sf_dir):
    return agg.stance_counts(arguments(spark, sf_dir).withColumnRenamed("n_name", "party"), "o_orderstatus", ["party"])


@query(f"SELECT n_name AS party, count(*) AS total FROM {ARG} GROUP BY ROLLUP (n_name)")
def a03_rollup(spark, sf_dir):
    return arguments(spark, sf_dir).rollup(F.col("n_name").alias("party")).agg(F.count("*").alias("total"))


@query(f"SELECT n_name AS party, l_returnflag AS tag, count(*) AS n FROM {TAG} WHERE l_linestatus = 'F' GROUP BY 1, 2")
def a06_tags_per_party(spark, sf_dir):
    return tagged(spark, sf_dir).where("l_linestatus = 'F'").groupBy(F.col("n_name").alias("party"), F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS tag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, tag")
def a07_tag_usage(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query(f"""SELECT party, CAST(sum(n) AS BIGINT) AS total, string_agg(tag || '=' || n, ',' ORDER BY tag) AS tags FROM (SELECT n_name AS party, l_returnflag AS tag, count(*) AS n FROM {TAG} GROUP BY 1, 2) GROUP BY 1""")
def a08_party_tag_index(spark, sf_dir):
    n = tagged(spark, sf_dir).groupBy(F.col("n_name").alias("party"), F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"))
    m = n.groupBy("party").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("index"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("index")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("party", "total", text.alias("tags"))


@query("SELECT o_custkey, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS first_seen FROM orders GROUP BY 1")
def a09_person_index_first_seen(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min_by("o_orderpriority", "o_orderkey").alias("first_seen"))


@query(f"SELECT CASE WHEN n < 700 THEN 'overig' ELSE party END AS party, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n_name AS party, count(*) AS n FROM {ARG} GROUP BY 1) GROUP BY 1")
def a10_bucket_small_counts(spark, sf_dir):
    c = arguments(spark, sf_dir).groupBy(F.col("n_name").alias("party")).agg(F.count("*").alias("n"))
    return relational.small_counts(c, "party", "n", 700, "overig")


@query(
    f"""WITH f AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM {_FACETED})
SELECT 'stance' AS facet, o_orderstatus AS value, count(*) AS n, min(d) AS first_day FROM f WHERE {_R} AND {_T} GROUP BY 2
UNION ALL SELECT 'typology', o_orderpriority, count(*), min(d) FROM f WHERE {_S} AND {_R} AND {_T} GROUP BY 2
UNION ALL SELECT 'party', n_name, count(*), min(d) FROM f WHERE {_S} AND {_R} AND {_T} GROUP BY 2
UNION ALL SELECT 'role', c_mktsegment, count(*), min(d) FROM f WHERE {_S} AND {_T} GROUP BY 2
UNION ALL SELECT 'tag', t, count(*), min(d) FROM (SELECT unnest(tags) AS t, d FROM f WHERE {_S} AND {_R}) GROUP BY 2"""
)
def a11_facet_options(spark, sf_dir):
    return facet_query().options(faceted(spark, sf_dir), SELECTION, F.to_date("o_orderdate"))


@query(f"SELECT n_name AS party, {_STANCE} FROM (SELECT *, nullif(n_name, 'NATION_3') AS pn FROM {ARG}) WHERE pn IS NOT NULL GROUP BY 1")
def a13_party_positions(spark, sf_dir):
    a = arguments(spark, sf_dir).where(F.nullif(F.col("n_name"), F.lit("NATION_3")).isNotNull())
    p = a.groupBy(F.col("n_name").alias("party")).pivot("o_orderstatus", list(agg.STANCES)).agg(F.count(F.lit(1)))
    return p.select("party", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in agg.STANCES.items()])


@query("SELECT count(*) AS n, count(nullif(lang, 'de')) AS with_lang, count(nullif(source, 'src0')) AS with_source FROM documents")
def a14_pipeline_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("lang"), F.lit("de"))).alias("with_lang"), F.count(F.nullif(F.col("source"), F.lit("src0"))).alias("with_source"))


@query("SELECT source, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1) ORDER BY n DESC, source LIMIT 10")
def a15_off_topic_top10(spark, sf_dir):
    g = table(spark, sf_dir, "documents").where("lang <> 'en'").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "source").limit(10)


@query("""SELECT event_type AS stage, CAST(user_id % 3 AS BIGINT) AS model, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, count(*) FILTER (value > 400) AS errors,
    CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def a16_call_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("model")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.count(F.when(F.col("value") > 400, 1)).alias("errors"),
        F.sum(F.coalesce("k", F.lit(0))).alias("tokens"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("""SELECT CASE WHEN contains(m, ':') THEN 'remote' ELSE 'local' END AS bucket, CAST(sum(k) AS BIGINT) AS tokens, round(sum(k) * CASE WHEN contains(m, ':') THEN 0.0002 ELSE 0.0003 END / 1000, 9) AS kwh
    FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'm' || event_type ELSE 'm:' || event_type END AS m, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events) GROUP BY 1, contains(m, ':')""")
def a17_energy_split(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.concat(F.when(F.col("user_id") % 2 == 0, "m").otherwise("m:"), F.col("event_type"))
    e = e.select(F.when(m.contains(":"), "remote").otherwise("local").alias("bucket"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    g = e.groupBy("bucket").agg(F.sum("k").alias("tokens"))
    return g.select("*", F.round(F.col("tokens") * F.when(F.col("bucket") == "remote", 0.0002).otherwise(0.0003) / 1000, 9).alias("kwh"))


@query("""SELECT o_orderpriority AS topic, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS extracted, count(*) FILTER (o_orderstatus = 'O') AS waiting,
  count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS too_old, count(*) - count(*) FILTER (o_orderstatus IN ('F', 'O')) AS out_of_scope, count(DISTINCT o_custkey) AS actors FROM orders GROUP BY 1""")
def a18_topic_work_status(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("topic")).agg(
        F.count("*").alias("n"), n(s == "F").alias("extracted"), n(s == "O").alias("waiting"), n(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("too_old"),
        (F.count("*") - n(s.isin("F", "O"))).alias("out_of_scope"), F.countDistinct("o_custkey").alias("actors"),
    )


@query("SELECT o_custkey AS debate, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS needs_url, min(o_orderdate) AS started FROM orders GROUP BY 1")
def a20_a21_debates(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("debate")).agg(F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("needs_url"), F.min("o_orderdate").alias("started"))


@query(f"SELECT o_orderpriority AS debate, count(*) AS n, count(DISTINCT c_custkey) AS speakers, {_STANCE}, min(o_orderdate) AS first_day FROM {ARG} GROUP BY 1 ORDER BY n DESC, debate")
def a22_debate_summary(spark, sf_dir):
    n = [F.count(F.when(F.col("o_orderstatus") == k, 1)).alias(v) for k, v in agg.STANCES.items()]
    return arguments(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("debate")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("speakers"), *n, F.min("o_orderdate").alias("first_day")).orderBy(F.desc("n"), "debate")


@query("""SELECT o_custkey AS debate, string_agg(o_orderkey, ',' ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS arguments FROM orders GROUP BY 1""")
def a24_grouped_by_debate(spark, sf_dir):
    t = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("debate")).agg(F.sort_array(F.collect_list(F.struct(t.isNull().alias("late"), t.alias("t"), F.col("o_orderkey").alias("k")))).alias("a"))
    return g.select("debate", F.array_join(F.transform("a", lambda x: x["k"].cast("string")), ",").alias("arguments"))


@query("SELECT conv_id, role, min(turn) AS first_turn, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1, 2")
def a25_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query(f"SELECT p_brand AS tag, count(*) AS uses, count(DISTINCT n_name) AS parties FROM {TAG} GROUP BY 1")
def a26_tag_index_page(spark, sf_dir):
    return tagged(spark, sf_dir).groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("uses"), F.countDistinct("n_name").alias("parties"))


@query(f"""WITH c AS (SELECT n_name AS party, l_returnflag AS tag, count(*) AS n FROM {TAG} GROUP BY 1, 2), t AS (SELECT n_name AS party, count(*) AS total FROM {ARG} GROUP BY 1)
  SELECT party, tag, round(100.0 * n / total, 6) AS share, round(n * 1.0 / total / max(n * 1.0 / total) OVER (), 6) AS heat FROM c JOIN t USING (party) WHERE total >= 8""")
def a27_heatmap(spark, sf_dir):
    c = tagged(spark, sf_dir).groupBy(F.col("n_name").alias("party"), F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"))
    t = arguments(spark, sf_dir).groupBy(F.col("n_name").alias("party")).agg(F.count("*").alias("total")).where("total >= 8")
    r = F.col("n") / F.col("total")
    return c.join(t, "party").select("party", "tag", F.round(100 * r, 6).alias("share"), F.round(r / F.max(r).over(Window.partitionBy()), 6).alias("heat"))


@query("""WITH e AS (SELECT o_custkey AS e, p_brand AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'),
  t AS (SELECT e, count(*) AS total FROM e GROUP BY 1), n AS (SELECT e, tag, count(*) AS n FROM e GROUP BY 1, 2)
  SELECT tag, round(median(coalesce(n.n, 0) * 1.0 / total), 9) AS median_rate FROM t CROSS JOIN (SELECT DISTINCT tag FROM e) g LEFT JOIN n USING (e, tag) GROUP BY 1""")
def a28_median_tag_rate(spark, sf_dir):
    e = tagged(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("o_custkey").alias("e"), F.col("p_brand").alias("tag"))
    totals = e.groupBy("e").agg(F.count("*").alias("total"))
    m = agg.median_rates(agg.rates_with_zeros(e, totals, "e", "tag"), totals.count(), "tag")
    return m.select("tag", F.round("median_rate", 9).alias("median_rate"))


@query(f"SELECT c_name AS person, o_orderpriority AS topic, count(*) AS n FROM {ARG} GROUP BY 1, 2")
def a29_actor_topics(spark, sf_dir):
    return arguments(spark, sf_dir).groupBy(F.col("c_name").alias("person"), F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_brand AS tag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS k FROM c)
  SELECT CASE WHEN k <= 4 THEN tag ELSE 'rest' END AS tag, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def a30_top4_and_rest(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    c = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "tag").limit(4).select("tag", F.lit(True).alias("top"))
    return c.join(top, "tag", "left").groupBy(F.when(F.col("top"), F.col("tag")).otherwise("rest").alias("tag")).agg(F.sum("n").alias("n"))


@query("SELECT label, CAST(vec_id % 7 AS BIGINT) AS party, round(sum(CAST(1 + vec_id % 3 AS DOUBLE)), 4) AS weight FROM embeddings GROUP BY 1, 2")
def a31_cluster_party_weight(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 7).alias("party")).agg(F.round(F.sum(1.0 + F.col("vec_id") % 3), 4).alias("weight"))


@query("""WITH s AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 300) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 300) AS fp, count(*) FILTER (quality = 1 AND n_chars < 300) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1),
  r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS rc FROM s)
  SELECT lang, tp, fp, fn, round(p, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN p + rc = 0 THEN 0.0 ELSE 2 * p * rc / (p + rc) END, 9) AS f1 FROM r""")
def a32_micro_prf(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    long, good = F.col("n_chars") >= 300, F.col("quality") == 1
    d = d.select("lang", (good & long).cast("long").alias("tp"), (~good & long).cast("long").alias("fp"), (good & ~long).cast("long").alias("fn"))
    m = agg.micro_prf(d, ["lang"], "tp", "fp", "fn")
    return m.select("lang", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT event_type AS zoom, count(*) AS n, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, min(ts) AS first_ts FROM events GROUP BY 1")
def a34_a35_timing_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("zoom"))
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("top"), F.min("ts").alias("first_ts"))


@query("SELECT user_id, event_type, arg_min(ts, event_id) AS first_ts FROM events GROUP BY 1, 2")
def a36_first_occurrence(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("ts", "event_id").alias("first_ts"))


@query("""WITH a AS (SELECT o_custkey AS k, list_sort(list(o_orderstatus) FILTER (o_orderkey % 2 = 0)) AS x, list_sort(list(o_orderstatus) FILTER (o_orderkey % 2 = 1)) AS y FROM orders GROUP BY 1)
  SELECT k, coalesce(len(x), 0) = coalesce(len(y), 0) AS same_count, coalesce(x, []) = coalesce(y, []) AS same_stances FROM a""")
def a38_a39_repeat_comparison(spark, sf_dir):
    side = lambda r: F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderstatus"))))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(side(0).alias("x"), side(1).alias("y"))
    return g.select("k", (F.size("x") == F.size("y")).alias("same_count"), (F.col("x") == F.col("y")).alias("same_stances"))


@query("""WITH c AS (SELECT label AS a, CAST(vec_id % 10 AS BIGINT) AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
  s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n*(n-1)/2.0) FROM c) AS pab, (SELECT sum(n*(n-1)/2.0) FROM r) AS pa, (SELECT sum(n*(n-1)/2.0) FROM k) AS pb,
    (SELECT sum(n*ln(n)) FROM c) AS hab, (SELECT sum(n*ln(n)) FROM r) AS ha, (SELECT sum(n*ln(n)) FROM k) AS hb)
  SELECT round((pab - pa*pb/(n*(n-1)/2.0)) / ((pa+pb)/2 - pa*pb/(n*(n-1)/2.0)), 8) AS ari,
    round(((ln(n)-ha/n) + (ln(n)-hb/n) - (ln(n)-hab/n)) / (((ln(n)-ha/n) + (ln(n)-hb/n))/2), 8) AS nmi, CAST(n AS BIGINT) AS n FROM s""")
def a40_cluster_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b"))
    return agg.agreement(e, "a", "b").select(F.round("ari", 8).alias("ari"), F.round("nmi", 8).alias("nmi"), "n")


@query("SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def a41_duplicate_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread, round(median(value), 6) AS mid, max(value) - min(value) > 450 AS flagged FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 3""")
def a42_calibration_spread(spark, sf_dir):
    g = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("s"), F.round(F.median("value"), 6).alias("mid"))
    return g.where("n >= 3").select("user_id", "n", F.round("s", 6).alias("spread"), "mid", (F.col("s") > 450).alias("flagged"))


@query("SELECT user_id AS url, max(ts) AS checked, arg_max(event_type, ts) AS topic, arg_max(event_id, ts) AS id FROM events GROUP BY 1")
def a43_latest_row_per_url(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url")).agg(F.max("ts").alias("checked"), F.max_by("event_type", "ts").alias("topic"), F.max_by("event_id", "ts").alias("id"))


@query("SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY 1")
def a44_points_per_topic(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_type AS tag_group, p_brand AS tag FROM part ORDER BY 1, 2")
def a45_ordered_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("tag_group"), F.col("p_brand").alias("tag")).distinct().orderBy("tag_group", "tag")


@query("""SELECT o_orderpriority AS topic, n, string_agg(o_orderkey, ',' ORDER BY k) AS examples FROM (SELECT o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 5 GROUP BY 1, 2""")
def a46_counts_and_examples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "topic")
    n = o.groupBy("topic").agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic").orderBy(F.desc("o_orderdate"), "o_orderkey")
    e = o.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("k", "o_orderkey"))).alias("x"))
    return n.join(e, "topic").select("topic", "n", F.array_join(F.transform("x", lambda s: s["o_orderkey"].cast("string")), ",").alias("examples"))


# Rankings and windows


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w01_best_per_group(spark, sf_dir):
    return relational.best_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH c AS (SELECT s_nationkey AS c, count(*) AS n FROM supplier GROUP BY 1) SELECT c, n, round(2 + (row_number() OVER (ORDER BY n DESC, c) - 1) * 1.0 / greatest(count(*) OVER () - 1, 1) * 6, 6) AS min_zoom FROM c""")
def w05_label_min_zoom(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    r = (F.row_number().over(Window.orderBy(F.desc("n"), "c")) - 1) / F.greatest(F.count("*").over(every) - 1, F.lit(1))
    return c.select("c", "n", F.round(2 + r * 6, 6).alias("min_zoom"))


@query("SELECT lang, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS id FROM (SELECT lang, min(doc_id) AS f FROM documents GROUP BY 1)")
def w09_first_seen_ids(spark, sf_dir):
    return relational.first_seen_ids(table(spark, sf_dir, "documents"), "lang", "doc_id", "id")


_TOPN = """WITH t AS (SELECT o_custkey AS person, count(*) AS total FROM orders GROUP BY 1), c AS (SELECT o_orderpriority AS tag, o_custkey AS person, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT tag, person, n, total FROM c JOIN t USING (person) WHERE n >= 3 AND total >= 8 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY n * 1.0 / total DESC, n DESC, person) <= 5"""


@query(_TOPN)
def w10_l05_top_persons_per_tag(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = o.groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("total")).where("total >= 8")
    c = o.groupBy(F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("person")).agg(F.count("*").alias("n")).where("n >= 3")
    return relational.best_per_group(c.join(t, "person"), ["tag"], [F.desc(F.col("n") / F.col("total")), F.desc("n"), F.col("person")], 5).select("tag", "person", "n", "total")


@query("SELECT label, string_agg(vec_id, ',' ORDER BY s DESC, vec_id) AS members FROM (SELECT label, vec_id, vec_id % 5 AS s FROM embeddings) GROUP BY 1")
def w11_ordered_children(spark, sf_dir):
    g = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct((-(F.col("vec_id") % 5)).alias("s"), "vec_id"))).alias("m"))
    return g.select("label", F.array_join(F.transform("m", lambda x: x["vec_id"].cast("string")), ",").alias("members"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 300")
def l01_l02_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(300).select("event_id", "ts", "event_type")


@query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey LIMIT 50")
def l03_nulls_last(spark, sf_dir):
    t = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").orderBy(t.asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey")


@query("""WITH c AS (SELECT n_name AS person, o_orderpriority AS tag, count(*) AS n FROM """ + ARG + """ GROUP BY 1, 2),
  s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY person) AS share, (n * 1.0 / sum(n) OVER (PARTITION BY person)) / (sum(n) OVER (PARTITION BY tag) * 1.0 / sum(n) OVER ()) AS lift FROM c)
  SELECT person, tag, n, round(share, 8) AS share, round(lift, 8) AS lift FROM s WHERE share >= 0.05 QUALIFY row_number() OVER (PARTITION BY person ORDER BY round(lift, 8) DESC, tag) <= 3""")
def l06_lift_favourites(spark, sf_dir):
    c = arguments(spark, sf_dir).groupBy(F.col("n_name").alias("person"), F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("n"))
    s = agg.lift(c, "person", "tag", "n").where("share >= 0.05").withColumn("lift", F.round("lift", 8))
    return relational.best_per_group(s, ["person"], [F.desc("lift"), F.col("tag")], 3).select("person", "tag", "n", F.round("share", 8).alias("share"), "lift")


@query(f"""WITH p AS (SELECT n_name AS party, {_STANCE} FROM {ARG} GROUP BY 1), d AS (SELECT *, CASE WHEN pro >= contra AND pro >= unclear THEN 'pro' WHEN contra >= unclear THEN 'contra' ELSE 'unclear' END AS side FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY pro + contra + unclear DESC, party) AS k, count(*) OVER (PARTITION BY side) AS size FROM d)
  SELECT party, side, k, greatest(size - 4, 0) AS overflow FROM r WHERE k <= 4""")
def l07_dominant_stance(spark, sf_dir):
    a = agg.stance_counts(arguments(spark, sf_dir).withColumnRenamed("n_name", "party"), "o_orderstatus", ["party"])
    a = a.withColumn("side", agg.dominant(F.col("pro"), F.col("contra"), F.col("unclear")))
    w = Window.partitionBy("side")
    r = a.withColumn("k", F.row_number().over(w.orderBy(F.desc("total"), "party")).cast("long")).withColumn("size", F.count("*").over(w))
    return r.where("k <= 4").select("party", "side", "k", F.greatest(F.col("size") - 4, F.lit(0)).alias("overflow"))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS debate, p_brand AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), d AS (SELECT tag, count(*) AS df FROM t GROUP BY 1)
  SELECT debate, tag, df FROM t JOIN d USING (tag) QUALIFY row_number() OVER (PARTITION BY debate ORDER BY df, tag) <= 3""")
def l08_rarest_tags(spark, sf_dir):
    o, li, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    t = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.col("o_custkey").alias("debate"), F.col("p_brand").alias("tag")).distinct()
    d = t.groupBy("tag").agg(F.count("*").alias("df"))
    return relational.best_per_group(t.join(d, "tag"), ["debate"], [F.col("df"), F.col("tag")], 3).select("debate", "tag", "df")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_linestatus <> 'F', md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 6")
def l09_highlights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    h = F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    return li.orderBy(F.col("l_linestatus") != "F", h, "l_orderkey", "l_linenumber", "l_partkey").limit(6).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def l10_l11_ranked_valid(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 1000").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey")


@query("SELECT o_custkey AS doc, count(DISTINCT o_orderpriority) AS clusters, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def l12_qualitative_examples(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.countDistinct("o_orderpriority").alias("clusters"), F.count("*").alias("n"))
    return g.where("clusters >= 2").orderBy(F.desc("clusters"), F.desc("n"), "doc").limit(10)


@query("SELECT o_custkey AS debate, n, CASE WHEN k <= 2 THEN 'featured' WHEN k <= 6 THEN 'expanded' ELSE 'compact' END AS tier FROM (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS k FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))")
def l14_display_tiers(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("debate")).agg(F.count("*").alias("n"))
    # Only the six that stand out are ranked; ranking all would need them in one place.
    top = g.orderBy(F.desc("n"), "debate").limit(6).select("debate", F.row_number().over(Window.orderBy(F.desc("n"), "debate")).alias("k"))
    tier = F.when(F.col("k") <= 2, "featured").when(F.col("k") <= 6, "expanded").otherwise("compact")
    return g.join(F.broadcast(top), "debate", "left").select("debate", "n", tier.alias("tier"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 45 ORDER BY n DESC, label")
def l15_visible_labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).where("n >= 45").orderBy(F.desc("n"), "label")


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2")
def l16_external_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    order = relational.first_seen_ids(p, "p_type", "p_partkey", "at")
    c = p.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return c.join(order, "p_type").orderBy("at", F.desc("n"), "p_brand").select("p_type", "p_brand", "n")


# Set operations


@query("SELECT o_orderkey AS id, 'orders' AS topic FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT doc_id, 'documents' FROM documents WHERE lang = 'en'")
def u01_union_topics(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("topic"))
    return a.unionByName(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("documents").alias("topic")))


@query("SELECT lower(n_name) AS word FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT lower(c_mktsegment) FROM customer")
def u02_stopword_union(spark, sf_dir):
    cols = [("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")]
    parts = [table(spark, sf_dir, t).select(F.lower(c).alias("word")) for t, c in cols]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("""SELECT item_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS rest FROM
  (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a, ['the', 'of', 'and', 'to', 'in'] AS b FROM benchmark)""")
def u03_u05_token_sets(spark, sf_dir):
    a = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    b = F.array(*[F.lit(x) for x in ("the", "of", "and", "to", "in")])
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(F.array_except(a, b)).cast("long").alias("rest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def u06_stale_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey").distinct()
    return o.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""WITH o AS (SELECT p_brand AS c, l_suppkey AS m FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2), n AS (SELECT p_brand AS c, l_suppkey AS m FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
  i AS (SELECT o.c AS old_c, n.c AS new_c, count(*) AS n_both FROM o JOIN n USING (m) GROUP BY 1, 2), os AS (SELECT c AS old_c, count(*) AS os FROM o GROUP BY 1), ns AS (SELECT c AS new_c, count(*) AS ns FROM n GROUP BY 1)
  SELECT old_c, new_c, n_both, round(n_both * 1.0 / (os + ns - n_both), 9) AS jaccard, round(n_both * 1.0 / least(os, ns), 9) AS containment FROM i JOIN os USING (old_c) JOIN ns USING (new_c)
  WHERE n_both * 1.0 / (os + ns - n_both) >= 0.6 OR (n_both * 1.0 / least(os, ns) >= 0.8 AND n_both >= 5)""")
def j24_u07_set_similarity(spark, sf_dir):
    from ..operators import similarity

    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("p_brand").alias("c"), F.col("l_suppkey").alias("m")).distinct()
    return similarity.match_sets(side("A"), side("R"))


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def u08_dedup_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return relational.best_per_group(e, ["user_id", "d"], [F.desc("event_id")]).select("event_id", "user_id", "ts")


@query("SELECT lang, CAST(max(CAST(DATE '2024-01-01' AS DATE) + CAST(doc_id % 28 AS INT)) - 7 AS DATE) AS crawl_from FROM documents GROUP BY 1")
def s18_t05_incremental_cutoff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    return relational.incremental_cutoff(d, day, ["lang"], 7)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END, o_orderkey) = 1")
def s06_best_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    final = F.col("o_orderstatus") == "F"
    p = F.when(final & (F.col("o_orderpriority") == "1-URGENT"), 0).when(final, 1).otherwise(2)
    return relational.best_per_group(o, ["o_custkey"], [p, F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT lang, source, count(*) AS n FROM documents WHERE contains(lower(text), 'the') AND n_chars > 100 GROUP BY 1, 2")
def s17_keyword_probe(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").contains("the") & (F.col("n_chars") > 100)).groupBy("lang", "source").agg(F.count("*").alias("n"))
