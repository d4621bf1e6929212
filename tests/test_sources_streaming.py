import json

import pytest
from pyspark.sql import functions as F

from rostrum.sources import readers, sinks
from rostrum.streaming import live


def test_vtt(spark):
    vtt = "WEBVTT\r\n\r\nNOTE x\r\n\r\n1\r\n05:00:00.000 --> 05:00:02.500 align:start\r\nHallo\r\n  wereld \r\n\r\n00:10.250 --> 00:12.000\nTwee\n"
    got = [tuple(r) for r in readers.vtt_cues(spark.createDataFrame([(vtt,)], "v string"), "v").collect()]
    assert got == [(0, 18000.0, 18002.5, "Hallo wereld"), (1, 10.25, 12.0, "Twee")]


def test_transcripts(spark, tmp_path):
    x = '<?xml version="1.0"?><m:meeting xmlns:m="urn:m"><m:activity id="1"><m:title>Stikstof</m:title><m:turn kind="speech"><m:speaker>A</m:speaker><m:text>een</m:text></m:turn><m:turn><m:speaker>B</m:speaker></m:turn></m:activity><m:activity id="2"><m:title>Zorg</m:title><m:turn><m:speaker>C</m:speaker><m:text>over Stikstof</m:text></m:turn><m:turn><m:speaker>D</m:speaker><m:text>niets</m:text></m:turn></m:activity></m:meeting>'
    (tmp_path / "t.xml").write_text(x)
    t = readers.transcript_turns(spark, [str(tmp_path / "t.xml")])
    assert sorted((r.activity, r.pos, r.speaker, r.text) for r in t.collect()) == [("1", 0, "A", "een"), ("2", 0, "C", "over Stikstof"), ("2", 1, "D", "niets")]
    assert sorted(r.speaker for r in readers.topic_turns(t, "stikstof").collect()) == ["A", "C"]


def test_event_log_drops_incomplete(spark):
    log = json.dumps({"startedAt": "2024-01-01T10:00:00Z", "events": [{"eventType": "speak", "eventStart": "2024-01-01T10:00:05.500Z", "objectId": "x"}, {"eventType": "speak", "objectId": "y"}, {"eventStart": "bad", "eventType": "a", "objectId": "z"}]})
    got = [tuple(r) for r in readers.event_log(spark.createDataFrame([(log,), ("{broken",), (None,)], "r string"), "r").collect()]
    assert got == [("speak", "x", 5.5)]


def test_small_files(spark, tmp_path):
    (tmp_path / "t.toml").write_text('[[tag]]\nkey = "a"\ngroup = "g"\n[[tag]]\nkey = "b"\n')
    assert sorted(map(tuple, readers.toml_tables(spark, str(tmp_path / "t.toml"), "tag", "key string, group string").collect()), key=repr) == [("a", "g"), ("b", None)]
    with pytest.raises(ValueError):
        readers.toml_tables(spark, str(tmp_path / "t.toml"), "tag", "key string")
    (tmp_path / "s.csv").write_text('id;text\n1;"a ""q"" b"\n2;c\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "s.csv"), "id int, text string", ";").collect()] == [(1, 'a "q" b'), (2, "c")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, 2]


def test_paged_source(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"value": [{"id": i * 10 + j} for j in range(3 - i)]}))
    spark.dataSource.register(readers.PagedSource)
    df = spark.read.format("paged").option("path", str(tmp_path)).option("pages", 3).load()
    assert sorted((r.page, json.loads(r.record)["id"]) for r in df.collect()) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11)]
    assert readers.page_url("E", ["a", "b"], where="x eq 1", top=999, skip=250) == "E?$filter=x%20eq%201&$select=a,b&$top=250&$skip=250"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "a", float("nan"))], "id int, topic string, x double")
    sinks.write_partitioned_json(df, str(tmp_path / "j"), ["topic"])
    assert spark.read.json(str(tmp_path / "j/topic=a")).count() == 2
    rows, dims = sinks.compact_points(df.withColumn("y", F.col("x")), ["topic"], "id")
    assert {r.id: r.row for r in rows.collect()} == {1: [1.0, 1.0, 0.0], 2: [2.0, 2.0, 1.0]}
    with pytest.raises(ValueError):
        sinks.guard_size(df, "topic", 3)
    nested = df.select("id", F.struct("topic", "x").alias("s"))
    assert sinks.lean(nested, ["s.x"]).schema["s"].dataType.names == ["topic"]
    for _ in range(2):
        sinks.append_parts(df, str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    ring = sinks.feature(sinks.ring_geometry(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    assert json.loads(spark.range(1).select(ring.alias("f")).first().f)["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]


def stream(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), spark.read.parquet(src)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_window_text_streams_as_it_runs_in_batch(spark, sf, tmp_path):
    s, b = stream(spark, sf, tmp_path)
    args = ("ts", "event_id", "event_type", [], "16 seconds", "8 seconds")
    # A delay longer than the table's month: whatever order files come in, nothing is late.
    got = {r.start: r.text for r in drain(live.window_text(s, *args, delay="60 days"), "wt", "complete").collect()}
    assert got == {r.start: r.text for r in live.window_text(b, *args).collect()}


def test_stream_dedup(spark, sf, tmp_path):
    s, b = stream(spark, sf, tmp_path)
    assert drain(live.dedup(s.unionByName(s), ["event_id"], "ts", "60 days"), "dd").count() == b.count()


def test_batches_resume(spark, sf, tmp_path):
    s, b = stream(spark, sf, tmp_path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    asked = []
    q = live.run_in_batches(s, out, cp, lambda d: d.select("event_id"), lambda: len(asked) < 1 and not asked.append(1))
    with pytest.raises(Exception, match="breaker"):
        q.awaitTermination()
    assert spark.read.parquet(out).count() < b.count()
    live.run_in_batches(s, out, cp, lambda d: d.select("event_id")).awaitTermination()
    assert spark.read.parquet(out).select("event_id").distinct().count() == b.count() == spark.read.parquet(out).count()


def test_idle_clear(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:05"), (9, "2024-01-01 01:00:00"), (9, "2024-01-01 02:00:00")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k long, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
        del i
    s = spark.readStream.schema("k long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {(r.k, str(r["at"])) for r in drain(live.idle_clear(s, "k", "ts"), "ic").where("action = 'clear'").collect()}
    assert {(1, "2024-01-01 00:00:50"), (2, "2024-01-01 00:00:45")} <= got


def test_sessions(spark, sf, tmp_path):
    _, b = stream(spark, sf, tmp_path)
    assert live.session_counts(b, "ts", ["user_id"], "6 hours").agg(F.sum("n")).first()[0] == b.count()


def test_cue_table_function(spark):
    from pyspark.errors import AnalysisException

    from rostrum.functions import table_functions

    table_functions.register(spark)
    text = "WEBVTT\n\nNOTE nothing\n\n7\n00:01.500 --> 00:02.000 align:start\nfirst\n  line two \n\n00:00:03.000 --> 01:00:04.250\n00:05.000 --> 00:06.000\nlast"
    rows = [("a", i, x) for i, x in enumerate(text.split("\n"))] + [("b", 2, "alone"), ("b", 1, "0:07.000 --> 0:08.000"), ("b", 3, None), ("b", 4, "behind"), (None, 1, "0:01.000 --> 0:02.000"), ("c", 0, None)]
    lines = spark.createDataFrame(rows, "key string, n int, line string").repartition(5)
    got = [tuple(r) for r in spark.sql("SELECT * FROM parse_cues(TABLE({t})) ORDER BY key, pos", t=lines).collect()]
    assert got == [(None, 0, 1.0, 2.0, ""), ("a", 0, 1.5, 2.0, "first line two"), ("a", 1, 3.0, 3604.25, ""), ("a", 2, 5.0, 6.0, "last"), ("b", 0, 7.0, 8.0, "alone")]
    assert spark.sql("SELECT * FROM parse_cues(TABLE({t}))", t=lines.where("key = 'none'")).count() == 0
    with pytest.raises(AnalysisException, match="key, n and line"):
        spark.sql("SELECT * FROM parse_cues(TABLE({t}))", t=lines.drop("n")).collect()

