"""Queries that join several families: token counts, fragment spans, debate lists, parent names, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text
from ..operators import intervals, relational
from ..session import scratch_path
from ..sources import sinks
from .registry import query


@query()
def x14_token_count(spark, sf_dir):
    import public_tokenizers

    from ..functions.tokens import token_counter

    count = token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", count("text").alias("n_tokens"))


_RUN = "(SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM conversations)"


@query(
    f"""WITH c AS {_RUN}, o AS (SELECT conv_id, turn, CAST(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS e FROM c), r AS (SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS running FROM c GROUP BY 1),
  f AS (SELECT conv_id, turn, split_part(t, ' ', 1) || '.*?' || split_part(t, ' ', 3) AS p FROM c WHERE split_part(t, ' ', 3) <> ''), m AS (SELECT conv_id, f.turn, running, regexp_extract(running, p) AS hit FROM f JOIN r USING (conv_id)),
  s AS (SELECT conv_id, turn, instr(running, hit) - 1 AS a, instr(running, hit) - 1 + length(hit) AS z FROM m WHERE hit <> '')
  SELECT s.conv_id, s.turn, CAST(a AS BIGINT) AS start_offset, CAST(z AS BIGINT) AS end_offset, min(o.turn) FILTER (o.e > a) AS first_turn, min(o.turn) FILTER (o.e >= z) AS last_turn FROM s JOIN o USING (conv_id) GROUP BY 1, 2, 3, 4"""
)
def c06_x04_fragment_spans(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("t"))
    cues = intervals.running_offsets(c, "conv_id", "turn", F.col("t")).select("conv_id", F.col("turn").alias("cue"), F.col("end_offset").alias("e"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ").alias("running"))
    part = lambda i: F.split_part("t", F.lit(" "), F.lit(i))
    f = c.where(part(3) != "").select("conv_id", "turn", F.concat(part(1), F.lit(".*?"), part(3)).alias("p"))
    s = text.fragment_span(F.col("running"), F.col("p"))
    spans = f.join(whole, "conv_id").select("conv_id", "turn", s.alias("s")).where("s IS NOT NULL").select("conv_id", "turn", F.col("s.start").alias("start_offset"), F.col("s.end").alias("end_offset"))
    first = F.min(F.when(F.col("e") > F.col("start_offset"), F.col("cue"))).alias("first_turn")
    last = F.min(F.when(F.col("e") >= F.col("end_offset"), F.col("cue"))).alias("last_turn")
    return spans.join(cues, "conv_id").groupBy("conv_id", "turn", "start_offset", "end_offset").agg(first, last)


@query(
    """WITH t AS (SELECT o_custkey AS debate, l_returnflag AS tag, count(*) AS n, min(l_partkey) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1, 2), d AS (SELECT o_custkey AS debate, count(*) AS arguments, min(o_orderdate) AS first_day FROM orders GROUP BY 1)
  SELECT debate, arguments, first_day, string_agg(tag || ':' || n, ',' ORDER BY tag) AS tags, min(p) AS thumbnail FROM d JOIN t USING (debate) GROUP BY 1, 2, 3"""
)
def a23_debate_list(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    t = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("debate"), F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("p"))
    tags = t.groupBy("debate").agg(F.array_join(F.array_sort(F.collect_list(F.concat("tag", F.lit(":"), F.col("n").cast("string")))), ",").alias("tags"), F.min("p").alias("thumbnail"))
    d = o.groupBy(F.col("o_custkey").alias("debate")).agg(F.count("*").alias("arguments"), F.min("o_orderdate").alias("first_day"))
    return d.join(tags, "debate").select("debate", "arguments", "first_day", "tags", "thumbnail")


@query(
    """WITH l AS (SELECT DISTINCT 1 AS level, CAST(label AS INT) AS id, CAST(label // 3 AS INT) AS parent, 'fine ' || label AS name FROM embeddings UNION SELECT DISTINCT 0, CAST(label // 3 AS INT), NULL, 'coarse ' || (label // 3) FROM embeddings)
  SELECT c.level, c.id, c.name, p.name AS parent_name FROM l c LEFT JOIN l p ON p.level = c.level - 1 AND p.id = c.parent"""
)
def c18_parent_names(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parent = F.floor(F.col("label") / 3).cast("int")
    fine = e.select(F.lit(1).alias("level"), F.col("label").cast("int").alias("id"), parent.alias("parent"), F.format_string("fine %d", "label").alias("name")).distinct()
    coarse = e.select(F.lit(0).alias("level"), parent.alias("id"), F.lit(None).cast("int").alias("parent"), F.concat(F.lit("coarse "), parent.cast("string")).alias("name")).distinct()
    return relational.parent_names(fine.unionByName(coarse))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS v FROM documents")
def c31_k10_incremental_cache(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents"), scratch_path(spark, "cache")
    value = lambda x: x.select("doc_id", F.length("text").cast("long").alias("v"))
    sinks.append_parts(value(d.where("doc_id % 3 = 0")), path, "doc_id")
    sinks.append_parts(value(d), path, "doc_id")  # only what is missing
    return spark.read.parquet(path)
