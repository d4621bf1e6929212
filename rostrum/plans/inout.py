"""Sources, sinks and live windows as queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import stream, table
from ..functions import table_functions
from ..operators import spatial
from ..session import scratch_path
from ..sources import ledger, readers, sinks, tile_archive, vector_tiles
from ..streaming import live, polling
from .analytics import _THIN
from .registry import query


@query("SELECT table_name, n FROM (SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem)")
def s01_table_scan(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("region", "nation", "documents", "lineitem")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, CAST(turn * 10 AS DOUBLE) AS start, CAST(turn * 10 + 2.5 AS DOUBLE) AS end, role AS text FROM conversations")
def s10_vtt_parse(spark, sf_dir):
    return readers.vtt_cues(_vtt(spark, sf_dir), "vtt", "conv_id")


@query("SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, CAST(turn * 10 AS DOUBLE) AS start, CAST(turn * 10 + 2.5 AS DOUBLE) AS end, role AS text FROM conversations")
def s10_cue_table_function(spark, sf_dir):
    """The same files line by line through the table function."""
    table_functions.register(spark)
    lines = _vtt(spark, sf_dir).select(F.col("conv_id").alias("key"), F.posexplode(F.split("vtt", "\n")).alias("n", "line"))
    return spark.sql("SELECT * FROM parse_cues(TABLE({lines}))", lines=lines)


def _vtt(spark, sf_dir):
    """A subtitle file per conversation, a cue per turn."""
    c = table(spark, sf_dir, "conversations")
    stamp = lambda ms: F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    cue = F.concat(F.lit("\n\n"), F.col("turn").cast("string"), F.lit("\n"), stamp(F.col("turn") * 10000), F.lit(" --> "), stamp(F.col("turn") * 10000 + 2500), F.lit(" align:start\n"), F.col("role"))
    return c.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "")).alias("vtt"))


@query("SELECT page_id, 'v-' || page_id || '.m3u8' AS variant, CASE WHEN page_id % 2 = 0 THEN 'sub.vtt' END AS subtitles FROM pages")
def s11_playlists(spark, sf_dir):
    t = F.concat(F.lit("#EXTM3U\n"), F.when(F.col("page_id") % 2 == 0, '#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="s",URI="sub.vtt"\n').otherwise(""), F.lit("#EXT-X-STREAM-INF:BANDWIDTH=1\nv-"), F.col("page_id").cast("string"), F.lit(".m3u8\nlow.m3u8\n"))
    return table(spark, sf_dir, "pages").select("page_id", readers.first_variant(t).alias("variant"), readers.subtitle_uri(t).alias("subtitles"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS object_id, CAST(event_id % 100 AS DOUBLE) AS seconds FROM events WHERE event_type <> 'error'")
def s09_event_log(spark, sf_dir):
    at = F.date_format(F.timestamp_seconds(F.col("event_id") % 100 + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(F.col("event_type"))
    log = F.to_json(F.struct(F.date_format(F.timestamp_seconds(F.lit(1700000000)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startedAt"), F.array(F.struct(kind.alias("eventType"), at.alias("eventStart"), F.col("user_id").cast("string").alias("objectId"))).alias("events")))
    return readers.event_log(table(spark, sf_dir, "events").select("event_id", log.alias("raw")), "raw", "event_id")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dims, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def s12_embedding_scan(spark, sf_dir):
    from ..functions.maths import norm

    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("""SELECT o_orderpriority AS topic, count(*) AS arguments, CAST(sum(len_tags) AS BIGINT) AS tags FROM orders JOIN (SELECT o_orderkey AS k, count(l_orderkey) AS len_tags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = o_orderkey GROUP BY 1""")
def k01_nested_export(spark, sf_dir):
    from ..operators.relational import nest

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    n = nest(o, li, "o_orderkey", "tags", ["l_linenumber", "l_returnflag"], ["l_linenumber", "l_returnflag"])
    record = F.to_json(F.struct("o_orderkey", "tags"))
    back = n.select("o_orderpriority", F.from_json(record, "o_orderkey long, tags array<struct<l_linenumber: int, l_returnflag: string>>").alias("r"))
    return back.groupBy(F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("arguments"), F.sum(F.size("r.tags")).alias("tags"))


@query("""SELECT doc_id, lang, id AS lang_id FROM documents JOIN (SELECT lang AS l, CAST(row_number() OVER (ORDER BY f) - 1 AS DOUBLE) AS id FROM (SELECT lang, min(doc_id) AS f FROM documents GROUP BY 1)) ON l = lang""")
def k04_compact_points(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").cast("double").alias("x"), F.col("n_chars").cast("double").alias("y"))
    rows, dims = sinks.compact_points(d, ["lang"], "doc_id")
    names = dims["lang"].select(F.col("lang_id").cast("double").alias("lang_id"), "lang")
    return rows.select("doc_id", F.col("row")[2].alias("lang_id")).join(names, "lang_id").select("doc_id", "lang", "lang_id")


@query(f"""SELECT topic, string_agg('## ' || s || chr(10) || items, chr(10) || chr(10) ORDER BY '## ' || s || chr(10) || items) AS document FROM (SELECT o_orderpriority AS topic, o_orderstatus AS s, string_agg('- “' || o_orderkey || '” — ' || o_custkey, chr(10) ORDER BY '- “' || o_orderkey || '” — ' || o_custkey) AS items FROM orders GROUP BY 1, 2) GROUP BY 1""")
def k05_markdown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").cast("string").alias("q"), F.col("o_custkey").cast("string").alias("w"))
    return sinks.markdown(o, "topic", "s", "q", "w")


@query("""SELECT vec_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || vec_id || ',' || label || ']},"properties":{"label":' || label || '}}' AS feature FROM embeddings""")
def k06_geojson_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", sinks.feature(sinks.point_geometry(F.col("vec_id").cast("long"), F.col("label").cast("long")), label=F.col("label")).alias("feature"))


@query()
def k07_tile_payloads(spark, sf_dir):
    from .analytics import points

    shown = spatial.thin(points(spark, sf_dir), [0, 1, 2, 3], 20, -10.0, 10.0, F.lit(1.0))
    return sinks.tile_payloads(shown).select("z", "tx", "ty", "n", F.octet_length("payload").alias("bytes"))


@query(f"""WITH t AS ({_THIN}), f AS (SELECT z, tx, ty, (x + 10) / 20 * pow(2, z) - tx AS fx, (10 - y) / 20 * pow(2, z) - ty AS fy FROM t), q AS (SELECT z, tx, ty, least(greatest(floor(fx * 4096), 0), 4095) AS px, least(greatest(floor(fy * 4096), 0), 4095) AS py FROM f),
  c AS (SELECT z, tx, ty, floor(px / 128) AS cx, floor(py / 128) AS cy, count(*) AS n FROM q GROUP BY ALL)
  SELECT z AS zoom, count(DISTINCT (tx, ty)) AS tiles, CAST(sum(n) AS BIGINT) AS points, count(*) AS cells, round(quantile_cont(n, 0.5) / 256, 9) AS per_px2_p50, round(quantile_cont(n, 0.9) / 256, 9) AS per_px2_p90, round(quantile_cont(n, 0.99) / 256, 9) AS per_px2_p99, round(max(n) / 256.0, 9) AS per_px2_max FROM c GROUP BY 1""")
def k07_s16_a37_archive_ink(spark, sf_dir):
    from .analytics import points

    shown = spatial.thin(points(spark, sf_dir), [0, 1, 2, 3, 4], 20, -10.0, 10.0, F.lit(1.0))
    path = scratch_path(spark, "tile-archive")
    tile_archive.write_archive(vector_tiles.point_tiles(shown, -10.0, 10.0), path, (-10.0, -10.0, 10.0, 10.0), {"name": "points", "format": "pbf"})
    ink = vector_tiles.ink_density(vector_tiles.tile_points(tile_archive.read_archive(spark, path)))
    return ink.select("zoom", "tiles", "points", "cells", *[F.round(f"per_px2_{c}", 9).alias(f"per_px2_{c}") for c in ("p50", "p90", "p99", "max")])


# Live windows


@query("""WITH s AS (SELECT *, CAST(floor(epoch_us(ts) / 8000000) AS BIGINT) * 8 AS b FROM events), w AS (SELECT b AS start_s, event_id, ts, event_type FROM s UNION ALL SELECT b - 8, event_id, ts, event_type FROM s)
  SELECT start_s, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text, count(*) AS n FROM w GROUP BY 1""")
def t02_t03_window_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.window_text(e, "ts", "event_id", "event_type", []).select(F.unix_seconds("start").alias("start_s"), "text", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY 1, 2")
def t01_bounded_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return live.dedup(e, ["user_id", "event_type", "d"], "ts", "1 day").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS start_s, count(*) AS n FROM r GROUP BY user_id, k""")
def t04_session_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.session_counts(e, "ts", ["user_id"], "6 hours").select("user_id", F.unix_seconds("start").alias("start_s"), "n")


@query("""WITH c AS (SELECT conv_id, turn, unnest([turn, turn + 1, turn + 2]) AS chunk FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS playlist, 'chunk-' || CAST(chunk AS VARCHAR) AS chunk, CAST(min(turn) AS INT) AS poll FROM c GROUP BY conv_id, chunk""")
def t01_polled_chunks(spark, sf_dir):
    """Every turn is a poll of its conversation's playlist that shows three chunks."""
    polls = stream(spark, sf_dir, "conversations")
    chunk = F.posexplode(F.transform(F.array(*map(F.lit, range(3))), lambda i: F.concat(F.lit("chunk-"), (F.col("turn") + i).cast("string")))).alias("place", "chunk")
    polls = polls.select(F.col("turn").cast("int").alias("poll"), F.timestamp_seconds(F.col("turn")).alias("at"), F.col("conv_id").cast("string").alias("playlist"), chunk)
    out = polling.finished(polling.fresh_chunks(polls), scratch_path(spark, "chunks"), scratch_path(spark, "chunks-checkpoint"))
    return out.select("playlist", "chunk", "poll")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, max(epoch_us(ts)) OVER () AS top FROM events)
  SELECT user_id, t AS at_us, 'show' AS action FROM e UNION ALL SELECT user_id, t + 40000000, 'clear' FROM e WHERE nxt - t > 40000000 OR (nxt IS NULL AND (top - 10000000) // 1000 > t // 1000 + 40000)""")
def t04_overlay_clears(spark, sf_dir):
    e = stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = polling.finished(polling.overlay(e, "user_id", "ts"), scratch_path(spark, "overlay"), scratch_path(spark, "overlay-checkpoint"))
    return out.select("user_id", F.unix_micros("at").alias("at_us"), "action")


def _answer(broken: bool):
    """Nothing for every fifth conversation; one in seven fails, always or at the first attempt."""

    def answer(key: str, attempt: int) -> str | None:
        n = int(key)
        if n % 5 == 0:
            return None
        if n % 7 == 1 and (broken or attempt == 1):
            raise TimeoutError
        return f"captions of {n}"

    return answer


@query("""WITH k AS (SELECT DISTINCT conv_id AS n FROM conversations), s AS (SELECT *, n % 5 <> 0 AND n % 7 = 1 AS failing FROM k)
  SELECT CAST(n AS VARCHAR) AS key, CASE WHEN n % 5 = 0 THEN 'none' ELSE 'found' END AS state, CASE WHEN failing THEN 2 ELSE 1 END AS asked, CASE WHEN failing THEN 172800 WHEN n % 2 = 0 THEN 0 ELSE 3600 END AS at_s, CASE WHEN n % 5 <> 0 THEN 'captions of ' || CAST(n AS VARCHAR) END AS payload FROM s""")
def s09_fetch_ledger(spark, sf_dir):
    """Three runs: half of the keys, all an hour later, and all after two days, when failures are due again."""
    keys, path = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key")), scratch_path(spark, "ledger")
    ledger.fetch(keys.where("key % 2 = 0"), ledger.Recorded(_answer(True)), path, "1970-01-01 00:00:00")
    ledger.fetch(keys, ledger.Recorded(_answer(True)), path, "1970-01-01 01:00:00")
    ledger.fetch(keys, ledger.Recorded(_answer(False)), path, "1970-01-03 00:00:00")
    rows = ledger.read(spark, path)
    asked = rows.groupBy("key").agg(F.count("*").cast("int").alias("asked"))
    return ledger.latest(rows).join(asked, "key").select("key", "state", "asked", F.unix_seconds("at").cast("int").alias("at_s"), "payload")
