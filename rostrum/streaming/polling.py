"""A polled playlist as a stream: an offset source, deduplication in bounded memory, and an overlay that clears itself.

``spark.readStream.format("polled_playlist")`` numbers the polls of a playlist; each lists the chunks it shows now, so neighbouring polls
overlap.  ``fresh_chunks`` keeps the ids seen per playlist in state, 300 of them once there are more than 1 000, in the order they came.
``overlay`` shows every row and clears the key when nothing was shown for longer than ``idle``; rows within a batch are put in order first, so
the result does not depend on where batches end.

Edge cases: a poll without chunks gives no rows; rows that come late, behind the watermark, are dropped as by any stateful operator;
equal times show one behind the other.
"""

from __future__ import annotations

import json

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

MOST, KEPT = 1000, 300


class PolledPlaylist(DataSource):
    """Option: ``path`` (folder of poll-N.json files, each {"at": seconds, "playlist": name, "chunks": [..]}, N from 0 without gaps, that stand
    for the service).  A client for a live service overrides the reader's ``poll`` and ``_exists``."""

    @classmethod
    def name(cls) -> str:
        return "polled_playlist"

    def schema(self) -> str:
        return "poll int, at timestamp, playlist string, place int, chunk string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Polls(dict(self.options))


class _Polls(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.known = 0

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _exists(self, poll: int) -> bool:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        return store.get_file_info(f"{root}/poll-{poll}.json").is_file

    def latestOffset(self) -> dict:
        while self._exists(self.known):
            self.known += 1
        return {"poll": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(p) for p in range(start["poll"], end["poll"])]

    def poll(self, number: int) -> dict:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        with store.open_input_stream(f"{root}/poll-{number}.json") as f:
            return json.loads(f.read())

    def read(self, partition: InputPartition):
        got = self.poll(partition.value)
        at = pd.Timestamp(got["at"], unit="s", tz="UTC").to_pydatetime()
        for place, chunk in enumerate(got["chunks"]):
            yield partition.value, at, got["playlist"], place, chunk

    def commit(self, end: dict) -> None:
        """Polls stay where they are."""


def remember(seen: list[str], new: list[str], most: int = MOST, kept: int = KEPT) -> list[str]:
    """The ids seen after one poll: the last ``kept`` of them once there are more than ``most``."""
    seen = seen + new
    return seen[-kept:] if len(seen) > most else seen


def fresh_chunks(polls: DataFrame, most: int = MOST, kept: int = KEPT) -> DataFrame:
    """playlist, poll, at, chunk: chunks that were not seen before, as far as memory reaches."""

    def step(key, frames, state):
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["poll", "place"])
        for _, poll in rows.groupby("poll", sort=True):
            known = set(seen)
            new = poll[~poll["chunk"].isin(known)].drop_duplicates("chunk")
            seen = remember(seen, new["chunk"].tolist(), most, kept)
            if len(new):
                yield new[["playlist", "poll", "at", "chunk"]]
        state.update((seen,))

    schema = "playlist string, poll int, at timestamp, chunk string"
    return polls.groupBy("playlist").applyInPandasWithState(step, schema, "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def overlay(df: DataFrame, key: str, ts: str, idle_ms: int = 40_000, delay: str = "10 seconds") -> DataFrame:
    """key, at, action: ``show`` for every row, ``clear`` at ``idle_ms`` after a row that nothing follows until then."""
    kind = dict(df.dtypes)[key]

    def step(k, frames, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "at": [pd.Timestamp(last + idle_ms * 1000, unit="us")], "action": ["clear"]})
            return
        last = state.get[0] if state.exists else None
        at, action = [], []
        for t in sorted(int(x.value // 1000) for f in frames for x in f[ts]):
            if last is not None and t - last > idle_ms * 1000:
                at.append(last + idle_ms * 1000)
                action.append("clear")
            at.append(t)
            action.append("show")
            last = t
        yield pd.DataFrame({key: [k[0]] * len(at), "at": pd.to_datetime(at, unit="us"), "action": action})
        state.update((last,))
        state.setTimeoutTimestamp(last // 1000 + idle_ms)

    return df.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, action string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def finished(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, append its rows to ``path``, and read them; a next run goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
