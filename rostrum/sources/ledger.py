"""What was asked of a service and what came of it: an append-only ledger, and a client called in batches.

Every answer is a row (key, state, at, payload): ``found`` with a payload, ``none`` (the service has nothing for the key, which is final) or
``failed``.  A key is due if it has no row, or if its latest one failed at least ``retry`` seconds ago.  Each run appends the rows of one folder,
committed as Spark commits a table, so a run that dies has asked nothing.

Edge cases: null keys are never due; of rows of one time the better state counts (found, none, failed); repeated keys are asked once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, state string, at timestamp, payload string"


class Client:
    """A service; ``ask`` answers a batch of keys in their order, None for a key that it has nothing for.

    An exception fails the whole batch, an exception in place of an answer one key.
    """

    #: Keys asked at once, attempts at a batch and, within one attempt, nothing else: waiting is the client's business.
    batch, attempts = 32, 2

    def ask(self, keys: list[str]) -> list:
        raise NotImplementedError


class Recorded(Client):
    """A deterministic stand-in: ``answer`` of a key and the number of the attempt, on any worker the same."""

    def __init__(self, answer: Callable[[str, int], str | None], batch: int = 32, attempts: int = 2):
        self.answer, self.batch, self.attempts = answer, batch, attempts
        self.tries: dict[str, int] = {}

    def ask(self, keys: list[str]) -> list:
        out = []
        for k in keys:
            self.tries[k] = self.tries.get(k, 0) + 1
            try:
                out.append(self.answer(k, self.tries[k]))
            except Exception as e:  # noqa: BLE001 - any failure of the service is one of its answers
                out.append(e)
        return out


def call(df: DataFrame, client: Client) -> DataFrame:
    """key, state, payload of every row's ``key``: batches per partition, failed keys asked again up to ``attempts`` times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), client.batch):
                got: dict[str, object] = {}
                left = f["key"].iloc[at : at + client.batch].tolist()
                keys = list(left)
                for _ in range(client.attempts):
                    try:
                        answers = client.ask(left)
                    except Exception as e:  # noqa: BLE001
                        answers = [e] * len(left)
                    got.update(zip(left, answers, strict=True))
                    left = [k for k in left if isinstance(got[k], Exception)]
                    if not left:
                        break
                state = ["failed" if isinstance(got[k], Exception) else "none" if got[k] is None else "found" for k in keys]
                payload = [str(got[k]) if s != "none" else None for k, s in zip(keys, state, strict=True)]
                yield pd.DataFrame({"key": keys, "state": state, "payload": payload})

    return df.select(F.col("key").cast("string").alias("key")).mapInPandas(run, "key string, state string, payload string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a ledger; one that was never written is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.option("recursiveFileLookup", "true").schema(SCHEMA).parquet(path)


def latest(ledger: DataFrame) -> DataFrame:
    """key, state, at, payload: the latest row of each key."""
    better = F.when(F.col("state") == "found", 2).when(F.col("state") == "none", 1).otherwise(0)
    row = F.struct("at", better.alias("better"), "state", "payload")
    return ledger.groupBy("key").agg(F.max(row).alias("r")).select("key", "r.state", "r.at", "r.payload")


def due(keys: DataFrame, ledger: DataFrame, now: str, retry: int = 86_400, force: bool = False) -> DataFrame:
    """The distinct keys to ask now."""
    own = keys.where(F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key")).distinct()
    if force:
        return own
    settled = (F.col("state") != "failed") | (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("at") < retry)
    return own.join(latest(ledger).where(settled).select("key"), "key", "left_anti")


def fetch(keys: DataFrame, client: Client, path: str, now: str, retry: int = 86_400, force: bool = False) -> None:
    """Ask for what is due and append the answers, stamped ``now``."""
    asked = due(keys, read(keys.sparkSession, path), now, retry, force)
    rows = call(asked, client).select("key", "state", F.lit(now).cast("timestamp").alias("at"), "payload")
    rows.write.parquet(f"{path}/run-{uuid.uuid4().hex}")
