"""Ledger: what is asked again and what is not; polled playlists: restarts, bounded memory, overlays over several batches."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rostrum.sources import ledger
from rostrum.streaming import polling


def states(spark, path):
    return {r.key: (r.state, r.payload) for r in ledger.latest(ledger.read(spark, path)).collect()}


def asked(spark, path):
    return {r.key: r["count"] for r in ledger.read(spark, path).groupBy("key").count().collect()}


def answer(key, attempt):
    if key == "never":
        raise TimeoutError("down")
    if key == "second" and attempt == 1:
        raise TimeoutError("down")
    return None if key == "no-subs" else f"text of {key}"


def test_second_run_asks_only_what_is_due(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    keys = spark.createDataFrame([("a",), ("no-subs",), ("never",), ("second",), ("a",), (None,)], "key string")
    ledger.fetch(keys, ledger.Recorded(answer), path, "2024-01-01 00:00:00", retry=3600)
    first = {"a": ("found", "text of a"), "no-subs": ("none", None), "second": ("found", "text of second"), "never": ("failed", "down")}
    assert states(spark, path) == first
    more = keys.unionByName(spark.createDataFrame([("b",)], "key string"))
    ledger.fetch(more, ledger.Recorded(answer), path, "2024-01-01 00:59:59", retry=3600)
    assert asked(spark, path) == {"a": 1, "no-subs": 1, "never": 1, "second": 1, "b": 1}
    ledger.fetch(more, ledger.Recorded(lambda k, _: "back"), path, "2024-01-01 01:00:00", retry=3600)
    assert asked(spark, path)["never"] == 2 and asked(spark, path)["no-subs"] == 1
    assert states(spark, path)["never"] == ("found", "back")
    ledger.fetch(more, ledger.Recorded(answer), path, "2024-01-02 00:00:00", force=True)
    assert min(asked(spark, path).values()) == 2


def test_batches_attempts_and_broken_batches(spark):
    class Fussy(ledger.Client):
        batch, attempts = 3, 2

        def ask(self, keys):
            if len(keys) > 3 or "bad" in keys and len(keys) > 1:
                raise ValueError("broken batch")
            return [None if k == "bad" else k.upper() for k in keys]

    df = spark.createDataFrame([(k,) for k in ("a", "b", "c", "bad", "d")], "key string").coalesce(1)
    got = {r.key: (r.state, r.payload) for r in ledger.call(df, Fussy()).collect()}
    assert got == {"a": ("found", "A"), "b": ("found", "B"), "c": ("found", "C"), "bad": ("failed", "broken batch"), "d": ("failed", "broken batch")}
    with pytest.raises(NotImplementedError):
        ledger.Client().ask([])


def test_latest_of_equal_times(spark):
    rows = [("k", "failed", datetime.fromisoformat("2024-01-01"), "x"), ("k", "found", datetime.fromisoformat("2024-01-01"), "y"), ("k", "none", datetime.fromisoformat("2023-01-01"), None)]
    assert ledger.latest(spark.createDataFrame(rows, ledger.SCHEMA)).first().payload == "y"
    assert ledger.latest(spark.createDataFrame([], ledger.SCHEMA)).count() == 0


def put(folder, number, chunks):
    (folder / f"poll-{number}.json").write_text(json.dumps({"at": 1000 + 4 * number, "playlist": "p", "chunks": chunks}))


def test_restarted_stream_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(polling.PolledPlaylist)
    (tmp_path / "polls").mkdir()

    def run():
        s = spark.readStream.format("polled_playlist").option("path", f"file://{tmp_path}/polls").load()
        return sorted((r.poll, r.chunk) for r in polling.finished(polling.fresh_chunks(s), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").collect())

    for n in range(3):
        put(tmp_path / "polls", n, [f"c{i:02d}" for i in range(n, n + 3)])
    want = [(0, "c00"), (0, "c01"), (0, "c02"), (1, "c03"), (2, "c04")]
    assert run() == want
    assert run() == want  # nothing new
    put(tmp_path / "polls", 3, [])
    put(tmp_path / "polls", 4, ["c04", "c05", "c05", "c06"])
    put(tmp_path / "polls", 6, ["c99"])  # behind a gap: not there yet
    assert run() == [*want, (4, "c05"), (4, "c06")]


def test_memory_keeps_the_last_ids():
    assert polling.remember(list("ab"), ["c"]) == ["a", "b", "c"]
    many = [str(i) for i in range(1000)]
    assert polling.remember(many[:-1], many[-1:]) == many
    assert polling.remember(many, ["x"]) == [*many[701:], "x"]


def test_forgotten_chunks_come_again(spark, tmp_path):
    rows = [(0, 1, "p", 0, "a"), (0, 1, "p", 1, "b"), (1, 2, "p", 0, "c"), (1, 2, "p", 1, "d"), (2, 3, "p", 0, "a"), (2, 3, "p", 1, "d"), (0, 1, "q", 0, "a")]
    df = spark.createDataFrame(rows, "poll int, s int, playlist string, place int, chunk string").select("poll", F.timestamp_seconds("s").alias("at"), "playlist", "place", "chunk")
    df.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = polling.finished(polling.fresh_chunks(s, most=3, kept=2), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r.playlist, r.poll, r.chunk) for r in out.collect()) == [("p", 0, "a"), ("p", 0, "b"), ("p", 1, "c"), ("p", 1, "d"), ("p", 2, "a"), ("q", 0, "a")]


def test_overlay_clears_after_forty_seconds(spark, tmp_path):
    def add(name, rows):
        df = spark.createDataFrame(rows, "k string, s double").select("k", F.timestamp_seconds(F.col("s") + 86400).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        out = polling.finished(polling.overlay(s, "k", "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
        return sorted((r.k, r["at"].timestamp() - 86400, r.action) for r in out.collect())

    show = lambda k, *t: [(k, float(x), "show") for x in t]
    got = add("one", [("a", 30.0), ("a", 0.0), ("a", 100.0), ("b", 10.0)])
    # b is cleared at 50: the watermark is at 90. a was cleared at 70, before it was shown again.
    assert got == sorted([*show("a", 0, 30, 100), ("a", 70.0, "clear"), *show("b", 10), ("b", 50.0, "clear")])
    got = add("two", [("a", 140.0), ("b", 145.0)])
    assert got == sorted([*show("a", 0, 30, 100, 140), ("a", 70.0, "clear"), *show("b", 10, 145), ("b", 50.0, "clear")])  # 40 s are not longer than 40 s
    got = add("three", [("c", 300.0)])
    assert [x for x in got if x[2] == "clear"] == [("a", 70.0, "clear"), ("a", 180.0, "clear"), ("b", 50.0, "clear"), ("b", 185.0, "clear")]
