"""Live text: sliding windows, bounded deduplication, idle clearing and resumable progress.

Each operator is a function of a DataFrame, streaming or not: the same plan runs over a stream and,
for checks, over a finished table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def dedup(df: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """One row per key; a stream forgets keys after ``delay``."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    return df.dropDuplicates(key)


def window_text(df: DataFrame, ts: str, seq: str, text: str, by: list[str], length: str = "16 seconds", step: str = "8 seconds", delay: str = "30 seconds") -> DataFrame:
    """Texts of each sliding window in order, joined by spaces."""
    df = df.withWatermark(ts, delay) if df.isStreaming else df
    w = df.groupBy(F.window(ts, length, step).alias("w"), *by).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), F.col(text).alias("x")))).alias("rows"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, F.array_join(F.transform("rows", lambda r: r["x"]), " ").alias("text"), F.size("rows").cast("long").alias("n"))


def session_counts(df: DataFrame, ts: str, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    df = df.withWatermark(ts, delay) if df.isStreaming else df
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def idle_clear(df: DataFrame, key: str, ts: str, idle_ms: int = 40_000, delay: str = "10 seconds") -> DataFrame:
    """key, at, action: ``show`` for every row, ``clear`` once nothing came for ``idle_ms`` of event time."""
    kind = dict(df.dtypes)[key]

    def step(k, frames, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "at": [pd.Timestamp(last + idle_ms, unit="ms")], "action": ["clear"]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f[ts].max().timestamp() * 1000))
            yield pd.DataFrame({key: f[key], "at": f[ts], "action": "show"})
        state.update((last,))
        state.setTimeoutTimestamp(last + idle_ms)

    return df.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, action string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def price_allows(baseline: dict | None, current: dict | None) -> bool:
    """No price is above the baseline's; an unknown price stops nothing."""
    if baseline is None or current is None:
        return True
    return all(current.get(k, 0) <= baseline.get(k, 0) for k in ("input", "output"))


def until_breaker(df: DataFrame, seq: str, every: int, ok: Column) -> DataFrame:
    """Rows up to the first check that fails; row ``seq`` is a check where it divides by ``every``.

    A null check passes.  The failing row is the first that is left out.
    """
    failed = df.where((F.col(seq) % every == 0) & ~F.coalesce(ok, F.lit(True)))
    stop = failed.agg(F.min(seq).alias("__stop"))  # one row
    return df.join(F.broadcast(stop), F.col("__stop").isNull() | (F.col(seq) < F.col("__stop"))).drop("__stop")


def run_in_batches(df: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], proceed: Callable[[], bool] = lambda: True):
    """Process new input once, batch by batch, appending results; restarts resume from the checkpoint.

    ``proceed`` is asked before every batch (a circuit breaker); when it says no, the run ends with an
    error and the batch stays unprocessed.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        if not proceed():
            raise RuntimeError("stopped by the breaker")
        # One folder per batch: a batch that is run again replaces its own output.
        work(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
