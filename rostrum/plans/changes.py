"""Validation of records, and changes to tables as new states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import merge, validation
from .registry import query

# Validation


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown stance' WHEN o_orderpriority = '5-LOW' THEN 'unknown typology' WHEN o_totalprice <= 1000 THEN 'empty quote' END AS reason FROM orders
  WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderpriority = '5-LOW' OR o_totalprice <= 1000""")
def v01_rejected_arguments(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rules = {"unknown stance": F.col("o_orderstatus").isin("F", "O"), "unknown typology": F.col("o_orderpriority") != "5-LOW", "empty quote": F.col("o_totalprice") > 1000}
    good, bad = validation.split(o, rules)
    return bad.select("o_orderkey", "reason")


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS arg, l_linestatus AS grp, l_returnflag AS tag FROM lineitem WHERE l_returnflag IN ('A', 'R')), n AS (SELECT arg, grp, count(*) AS n FROM v GROUP BY 1, 2)
  SELECT arg, grp, tag FROM v JOIN n USING (arg, grp) WHERE grp <> 'F' OR n = 1""")
def v02_valid_tags(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("arg"), F.col("l_linestatus").alias("grp"), F.col("l_returnflag").alias("tag")).distinct()
    vocab = spark.createDataFrame([("A",), ("R",)], "tag string")
    return validation.valid_tags(t, vocab, single=["F"])


@query("SELECT p_brand AS key, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1 HAVING count(*) > 1")
def v03_duplicate_keys(spark, sf_dir):
    return validation.duplicates(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_type").distinct(), "key")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 10 = 0 THEN 'override ' || p_partkey END, p_name) AS label, p_type AS parent FROM part""")
def v08_label_overrides(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_type").alias("parent"))
    over = p.where("p_partkey % 10 = 0").select("p_partkey", F.format_string("override %d", "p_partkey").alias("label"))
    return validation.override(p, over, "p_partkey", "label")


@query("SELECT CAST(0 AS BIGINT) AS uncovered, count(*) AS days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def d07_uncovered_days(spark, sf_dir):
    from .times import periods
    from ..operators.intervals import in_period

    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    hit = in_period(d, "day", periods(spark))
    return d.join(hit, "day", "left").agg(F.count(F.when(F.col("period").isNull(), 1)).alias("uncovered"), F.count("*").alias("days"))


# Changes


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 3 = 0")
def u1_insert_if_absent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return merge.insert_if_absent(d.where("doc_id % 3 <> 0"), d.withColumn("lang", F.lit("new")), ["doc_id"])


@query("""WITH old AS (SELECT row_number() OVER (ORDER BY c_mktsegment) AS id, c_mktsegment AS name, CAST(NULL AS VARCHAR) AS party FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment < 'F')), w AS (SELECT DISTINCT c_mktsegment AS name, CAST(NULL AS VARCHAR) AS party FROM customer)
  SELECT id, name, party FROM old UNION ALL SELECT (SELECT count(*) FROM old) + row_number() OVER (ORDER BY name), name, party FROM w WHERE name NOT IN (SELECT name FROM old)""")
def u2_get_or_create(spark, sf_dir):
    from pyspark.sql import Window

    w = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("party")).distinct()
    old = w.where("name < 'F'").select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", "party")
    return merge.get_or_create(old, w, ["name", "party"], "id")


@query("SELECT l_orderkey AS argument, l_returnflag AS tag, min(CASE WHEN l_linestatus = 'F' THEN 'llm' ELSE 'zderived' END) AS origin FROM lineitem GROUP BY 1, 2")
def u3_insert_or_ignore(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("argument"), F.col("l_returnflag").alias("tag"), "l_linestatus")
    have = t.where("l_linestatus = 'F'").select("argument", "tag", F.lit("llm").alias("origin")).distinct()
    return merge.insert_if_absent(have, t.select("argument", "tag", F.lit("zderived").alias("origin")), ["argument", "tag"])


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'llm' WHEN o_orderkey % 3 = 1 THEN 'derived' ELSE 'manual' END AS origin, CASE WHEN o_orderstatus = 'F' THEN 'valid' END AS status FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS k, 'ambiguous' AS status FROM orders WHERE o_orderkey % 5 = 0)
  SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'llm' ELSE origin END AS origin, CASE WHEN o.k IS NULL THEN n.status WHEN n.k IS NOT NULL AND origin = 'llm' AND o.status IS NULL THEN n.status WHEN n.k IS NULL AND origin = 'llm' AND o.status IS NULL THEN 'not reassessed' ELSE o.status END AS status FROM o FULL JOIN n ON o.k = n.k""")
def u4_conditional_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 3
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(m == 0, "llm").when(m == 1, "derived").otherwise("manual").alias("origin"), F.when(F.col("o_orderstatus") == "F", "valid").alias("status"))
    new = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), F.lit("llm").alias("origin"), F.lit("ambiguous").alias("status"))
    open_llm = (F.col("o.origin") == "llm") & F.col("o.status").isNull()
    return merge.merge(old, new, ["k"], {"status": F.when(open_llm, F.col("n.status")).otherwise(F.col("o.status"))}, {"status": F.when(open_llm, "not reassessed").otherwise(F.col("o.status"))})


@query("SELECT p_brand AS tag, CASE WHEN max(p_size) >= 25 THEN 'v2' ELSE 'v1' END AS version, max(p_size) >= 25 AS active FROM part GROUP BY 1")
def u5_reseed_taxonomy(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.max("p_size").alias("m"))
    old = b.select("tag", F.lit("v1").alias("version"), F.lit(True).alias("active"))
    once = merge.reseed(old, b.where("m >= 25").select("tag", F.lit("v2").alias("version")), ["tag"], "active")
    return merge.reseed(once, b.where("m >= 25").select("tag", F.lit("v2").alias("version")), ["tag"], "active")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events")
def u6_null_out_stale(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return merge.null_out(e, e.where("event_type = 'error'"), "event_id", ["value"]).select("event_id", "value")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'topic-b' WHEN o_orderstatus = 'F' THEN NULL ELSE 'topic-a' END AS topic FROM orders""")
def u7_relink(spark, sf_dir):
    # One projection from the old state: the reset comes first, then the relink wins over it.
    t = F.when(F.col("o_orderpriority") == "1-URGENT", "topic-b").when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise("topic-a")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("topic"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def u8_cascade_delete(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    _, kids = merge.cascade_delete(o, o.where("o_orderstatus = 'P'"), "o_orderkey", {"tags": li})
    return kids["tags"].select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber")


@query("SELECT d.doc_id, coalesce(nullif(lang, 'fr'), 'label-' || l.quality) AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def u9_backfill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("fr")).alias("lang"))
    v = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("lang"))
    return merge.backfill(d, v, "doc_id", "lang").select("doc_id", "lang")


@query("SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'appended', CAST(1 AS BIGINT)")
def u10_append_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    return e.unionByName(spark.createDataFrame([("appended", 1)], "stage string, n long"))
