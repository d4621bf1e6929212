"""Files and services: what is written in a format must come back from its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import facets, relational, spatial
from ..session import scratch_path
from ..sources import readers, sinks
from ..streaming import live
from .core import nested_arguments
from .registry import query


def _text(df: DataFrame, column, tag: str, *by: str, rows_per_file: int = 0) -> str:
    """Write one line per row, in a folder per value of ``by``, and return the path."""
    path = scratch_path(df.sparkSession, tag)
    df.select(*by, column.alias("value")).write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file).text(path)
    return path


# Transcripts: a conversation is an activity, its turns without a speaker are announcements.

SPOKEN = "FROM conversations WHERE turn % 5 <> 4 AND conv_id % 10 <> 3"


def _element(name: str, value):
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def transcripts(spark, sf_dir, folders: list[int]) -> DataFrame:
    """Turns of the transcripts in ``folders``; those of folder 3 have no sidecar and are skipped."""
    c = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("turn") % 5 != 4, _element("speaker", F.col("role"))).otherwise("")
    turn = F.concat(F.format_string('<turn kind="%s">', "turn"), speaker, _element("text", F.col("text")), F.lit("</turn>"))
    turns = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("x")))), lambda r: r["x"]), "")
    a = c.groupBy("conv_id").agg(turns.alias("turns")).withColumn("folder", F.col("conv_id") % 10)
    title = F.format_string("<title>Gesprek %d</title>", F.col("conv_id") % 7)
    activity = F.concat(F.format_string('<activity id="%d">', "conv_id"), title, F.col("turns"), F.lit("</activity>"))
    # A meeting has some fifty activities, so files are neither one an activity nor one a folder.
    meeting = a.groupBy("folder", F.floor(F.col("conv_id") / 500)).agg(F.sort_array(F.collect_list(F.struct("conv_id", activity.alias("x")))).alias("all"))
    xml = F.concat(F.lit("<meeting>"), F.array_join(F.transform("all", lambda r: r["x"]), ""), F.lit("</meeting>"))
    path = _text(meeting, xml, "transcripts", "folder", rows_per_file=1)  # a document has one root
    known = {r.folder for r in spark.read.text(path).select("folder").distinct().collect()}  # ten at most
    paths = [f"{path}/folder={i}" for i in folders if i in known]
    found = readers.transcript_turns(spark, paths)
    sidecars = spark.range(10).where("id <> 3").select(F.col("id").cast("string").alias("folder"))
    key = F.regexp_extract("file", r"folder=(\d+)", 1)
    return readers.with_sidecar(found, sidecars, key, "folder")


@query(
    f"""SELECT conv_id, CAST(turn AS INT) AS turn, role AS speaker, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text {SPOKEN} AND conv_id % 10 IN (0, 1, 3, 5)
  AND (conv_id % 7 = 2 OR contains(lower(text), 'tion') OR contains(lower(text), 'sch'))"""
)
def s02_transcript_topic(spark, sf_dir):
    t = readers.topic_turns(transcripts(spark, sf_dir, [0, 1, 3, 5]), "gesprek 2", "TION", "sch")
    return t.select(F.col("activity").cast("long").alias("conv_id"), F.col("kind").cast("int").alias("turn"), "speaker", "text")


@query(f"SELECT conv_id, 'Gesprek ' || (conv_id % 7) AS title, count(*) AS turns, sum(length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS chars {SPOKEN} GROUP BY 1, 2")
def s03_s04_transcript_turns(spark, sf_dir):
    t = transcripts(spark, sf_dir, list(range(10)))
    return t.groupBy(F.col("activity").cast("long").alias("conv_id"), "title").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


# Services


@query("SELECT c_custkey, c_name, CAST(c_custkey // 250 AS INT) AS page FROM customer WHERE c_nationkey < 20")
def s05_paged_scan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("page", F.floor(F.col("c_custkey") / 250).cast("int"))
    rows = c.groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey")).alias("value"))).alias("v"))
    path = _text(rows, F.col("v"), "pages", "page")
    pages = (c.agg(F.max("page")).first()[0] or 0) + 2  # the last one is empty
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("paged").option("path", path).option("pages", pages).load()
    r = got.select("page", F.from_json("record", "c_custkey long, c_name string, c_nationkey int").alias("r"))
    return r.where("r.c_nationkey < 20").select("r.c_custkey", "r.c_name", "page")


@query("SELECT 'Q' || c_custkey AS person, c_name AS name, c_mktsegment AS party, CASE WHEN c_custkey % 4 <> 0 THEN '1994-01-0' || (c_custkey % 4) END AS start FROM customer WHERE c_custkey % 3 <> 0")
def s07_office_holders(spark, sf_dir):
    val = lambda x: F.struct(x.alias("value"))
    key = F.col("c_custkey")
    party = F.when(key % 3 != 0, val(F.col("c_mktsegment")))
    start = F.when(key % 4 != 0, val(F.format_string("1994-01-0%d", key % 4)))
    uri = F.format_string("http://entities.example/entity/Q%d", "c_custkey")
    row = F.struct(val(uri).alias("person"), val(F.col("c_name")).alias("personLabel"), party.alias("partyLabel"), start.alias("start"))
    answer = F.to_json(F.struct(F.struct(F.collect_list(row).alias("bindings")).alias("results")))
    raw = table(spark, sf_dir, "customer").groupBy(F.floor(key / 500)).agg(answer.alias("raw"))
    b = readers.bindings(raw, "raw", ["person", "personLabel", "partyLabel", "start"]).where("partyLabel IS NOT NULL")
    return b.select(readers.entity_id(F.col("person")).alias("person"), F.col("personLabel").alias("name"), F.col("partyLabel").alias("party"), "start")


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M:%S') ELSE '12:00:00' END AS start
  FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-05', DATE '1800-01-01')"""
)
def s08_debate_agenda(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    real = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm:ss"))
    debate = F.struct(F.col("event_id").cast("string").alias("id"), real.alias("startedAt"), F.lit("12:00:00").alias("startsAt"))
    # A busy day has several pages of a thousand events' numbers each.
    days = e.groupBy("day", F.floor(F.col("event_id") / 1000)).agg(F.to_json(F.struct(F.collect_list(debate).alias("debates"))).alias("raw"))
    path = _text(days, F.col("raw"), "agenda", "day")
    kept = spark.read.text(path).withColumn("day", F.col("day").cast("string"))
    wanted = kept.where(F.col("day").isin("2024-01-03", "2024-01-05", "1800-01-01"))  # reads two folders
    return readers.agenda(wanted, "value", "day").select("day", "id", "start")


# Configuration and records


@query("SELECT n_name AS key, r_name AS grp, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS rank FROM nation JOIN region ON n_regionkey = r_regionkey")
def s13_toml_taxonomy(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rank = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("rank = "), F.col("n_nationkey").cast("string"), F.lit("\n"))).otherwise("")
    entry = F.concat(F.lit('[[tag]]\nkey = "'), "n_name", F.lit('"\ngrp = "'), "r_name", F.lit('"\n'), rank)
    all_tags = n.join(r, n.n_regionkey == r.r_regionkey).agg(F.array_join(F.collect_list(entry), "\n").alias("toml"))
    path = _text(all_tags, F.col("toml"), "taxonomy")
    return readers.toml_tables(spark, path, "tag", "key string, grp string, rank int")


@query("SELECT sep, conv_id, turn, text FROM conversations, (VALUES (','), (';')) AS s(sep)")
def s14_csv_speeches(spark, sf_dir):
    c, out = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), []
    for sep in ",;":
        path = scratch_path(spark, "speeches")
        w = c.write.option("header", True).option("sep", sep).option("escape", '"')
        w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        out.append(readers.csv_table(spark, path, "conv_id long, turn long, text string", sep).withColumn("sep", F.lit(sep)))
    return out[0].unionByName(out[1])


@query("SELECT conv_id, turn, role, text FROM conversations")
def s15_json_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.to_json(F.struct("conv_id", "turn", "role", "text")), F.lit("\n"))  # a blank line after each
    return readers.json_lines(spark, _text(c, line, "records"), "conv_id long, turn long, role string, text string")


# Exports


@query(
    """WITH t AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_returnflag AS key, l_linestatus AS grp FROM lineitem)
  SELECT p AS perspective, o_orderstatus AS topic, count(DISTINCT o.o_orderkey) AS arguments, count(key) AS tags
  FROM orders o JOIN (VALUES ('F'), ('O')) AS s(p) ON true LEFT JOIN t ON t.o_orderkey = o.o_orderkey AND grp = p GROUP BY 1, 2"""
)
def k02_fan_out(spark, sf_dir):
    a = nested_arguments(spark, sf_dir).withColumnRenamed("o_orderstatus", "topic")
    # Arguments are nested once, then each goes out once a perspective.
    each = a.withColumn("perspective", F.explode(F.array(F.lit("F"), F.lit("O"))))
    scoped = each.withColumn("tags", facets.scope_tags(F.col("tags"), "group", F.col("perspective")))
    path = scratch_path(spark, "export")
    sinks.write_partitioned_json(scoped, path, ["perspective", "topic"])
    back = spark.read.schema("o_orderkey long, tags array<struct<key: string>>, perspective string, topic string").json(path)
    return back.groupBy("perspective", "topic").agg(F.count("*").alias("arguments"), F.sum(F.size("tags")).cast("long").alias("tags"))


@query(
    """SELECT o_orderkey, string_agg(DISTINCT '{"key":"' || l_returnflag || '"}', ',' ORDER BY '{"key":"' || l_returnflag || '"}') AS tags FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1"""
)
def k03_lean_arguments(spark, sf_dir):
    a = nested_arguments(spark, sf_dir).withColumn("tags", facets.scope_tags(F.col("tags"), "group", "F"))
    lean = sinks.lean(a.withColumn("doc", F.struct("o_orderstatus", F.lit("x").alias("url"))), ["doc.url", "o_orderstatus"])
    assert lean.schema["doc"].dataType.names == ["o_orderstatus"]
    tags = F.transform("tags", lambda t: F.to_json(t.dropFields("group")))
    return lean.where(F.size("tags") > 0).select("o_orderkey", F.array_join(tags, ",").alias("tags"))


@query(
    """WITH v AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), s AS (SELECT label, count(*) AS size, sum(vec_id) AS members FROM embeddings GROUP BY 1)
  SELECT label, size, CAST(members AS BIGINT) AS members, CAST(pos - 1 AS INT) AS pos, round(avg(x), 5) AS mean FROM v JOIN s USING (label) GROUP BY 1, 2, 3, 4"""
)
def k09_anchors(spark, sf_dir):
    path = scratch_path(spark, "anchors")
    sinks.write_anchors(table(spark, sf_dir, "embeddings"), path, "label", "vec_id", "embedding")
    members = spark.read.parquet(f"{path}/members").groupBy("label").agg(F.sum("vec_id").alias("members"))
    return spark.read.parquet(f"{path}/anchors").join(members, "label").select("label", "size", "members", F.posexplode("mean_vector").alias("pos", "mean"))


@query()
def c26_smooth_hulls(spark, sf_dir):
    from .analytics import points

    hulls = spatial.hulls(points(spark, sf_dir).select("id", "label", "x", "y"), "label")
    return spatial.smooth_hulls(hulls, "label")


# Counts and order


@query(
    """SELECT n_name AS party, l_partkey AS tag, p_name AS description, p_type AS tag_group, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey
  WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R' AND p_size > 5 AND o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2, 3, 4"""
)
def a12_party_tag_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    li, c, n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    a = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    counts = a.groupBy("c_nationkey", F.col("l_partkey").alias("tag")).agg(F.count("*").alias("n"))  # names come after the count
    tags = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("tag"), F.col("p_name").alias("description"), F.col("p_type").alias("tag_group"))
    return counts.join(tags, "tag").join(n, counts.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("party"), "tag", "description", "tag_group", "n")


@query(
    """WITH t AS (SELECT l_returnflag AS flag, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE lower(p_brand) END AS tag, count(DISTINCT l_linestatus) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
  SELECT flag, tag, n, row_number() OVER (PARTITION BY flag ORDER BY n DESC, lower(tag), tag DESC) AS place FROM t"""
)
def l04_collated_order(spark, sf_dir):
    tag = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lower("p_brand")).alias("tag")
    parts = table(spark, sf_dir, "part").select("p_partkey", tag)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_linestatus", "l_partkey")
    t = li.join(parts, li.l_partkey == parts.p_partkey).groupBy("flag", "tag").agg(F.count_distinct("l_linestatus").alias("n"))
    return relational.collated_places(t, ["flag"], "n", "tag", "nl", "place")


# Long runs


@query("SELECT o_orderkey, o_totalprice FROM orders")
def t06_resumed_run(spark, sf_dir):
    """Stopped by the breaker after one batch, then resumed: every row once."""
    src, out, cp = (scratch_path(spark, t) for t in ("queue", "done", "progress"))
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("o_orderkey long, o_totalprice double").option("maxFilesPerTrigger", 1).parquet(src)
    prices = iter([{"input": 1.0, "output": 2.0}, {"input": 1.0, "output": 2.5}])
    rise = live.run_in_batches(stream, out, cp, lambda b: b, lambda: live.price_allows({"input": 1.0, "output": 2.0}, next(prices)))
    try:
        rise.awaitTermination()
    except Exception as stopped:
        if "stopped by the breaker" not in str(stopped):
            raise
    live.run_in_batches(stream, out, cp, lambda b: b).awaitTermination()
    return spark.read.parquet(out).drop("epoch")


@query("SELECT event_id, value FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE event_id % 100 = 0 AND value > 60)")
def t07_circuit_breaker(spark, sf_dir):
    return live.until_breaker(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 100, F.col("value") <= 60)
