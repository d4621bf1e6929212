"""Sharding by size-tiered compaction with versioned manifests.

A store is a folder: ``data/`` holds immutable Parquet shards, ``manifest/`` one JSON-lines file per
version.  ``append`` writes arrivals as many small shards in one job and commits a version that adds
them.  ``compact`` files shards by size tier (powers of ``fan_in``), merges every tier that holds
at least ``fan_in`` runs into files of about ``target_bytes`` by reading them side by side - no
shuffle - and commits a version in which the merged files replace their sources.  A version is
committed by giving a finished file its number in one exclusive step (a rename without overwrite; on a local
file system a hard link), which fails if the number is taken: readers see a version wholly or not at all,
and of two writers one has to start anew.  A store without such a rename is no place for manifests.
``vacuum`` deletes old data that the newest version does not name, such as the files of a failed job.

Edge cases: nulls, empty and long texts are stored as they are; an empty table commits an empty
version; repeated rows stay repeated; all columns are kept, whatever their names; a store without a
committed version has no rows and no schema, so reading it is an error.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    tier: int


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, small_bytes: int = 1 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan_in, self.small = target_bytes, fan_in, small_bytes
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)

    def _list(self, rel: str) -> list[tuple[str, int]]:
        p = self._p(rel)
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    # Manifests

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        return max((int(n[1:-5]) for n, _ in self._list("manifest") if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        v = self.version() if version is None else version
        if not v:
            return []
        stream = self._fs.open(self._p(f"manifest/v{v:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**json.loads(x)) for x in text.splitlines()[1:]]

    def schema(self) -> str:
        stream = self._fs.open(self._p(f"manifest/v{self.version():08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()[0])["schema"]
        finally:
            stream.close()

    def _commit(self, base: int, shards: list[Shard], schema: str) -> int:
        tmp, final = self._p(f"manifest/.tmp-{uuid.uuid4().hex}"), self._p(f"manifest/v{base + 1:08d}.json")
        out = self._fs.create(tmp, False)
        try:
            lines = [json.dumps({"version": base + 1, "schema": schema}), *(json.dumps(asdict(s)) for s in sorted(shards, key=lambda s: s.name))]
            out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
        finally:
            out.close()
        if not self._claim(tmp, final):
            self._fs.delete(tmp, False)
            raise Conflict(f"version {base + 1} is taken")
        return base + 1

    def _claim(self, tmp, final) -> bool:
        """Give the finished manifest its name if no other writer has it: one step that never overwrites."""
        if self._fs.getScheme() == "file":  # a hard link is the local file system's exclusive step
            try:
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            self._fs.delete(tmp, False)
            return True
        hadoop = self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(tmp, final, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def tier(self, size: int) -> int:
        """0 below ``small_bytes``, then one more for every factor ``fan_in``."""
        return 0 if size < self.small else 1 + int(math.log(size / self.small, self.fan_in))

    def _write(self, df: DataFrame, rows_per_file: int = 0) -> list[Shard]:
        run = f"r{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/data/{run}")
        return [Shard(f"{run}/{n}", size, self.tier(size)) for n, size in self._list(f"data/{run}") if n.endswith(".parquet")]

    # Writers

    def append(self, df: DataFrame, rows_per_file: int = 0) -> int:
        """Add arrivals as small shards of at most ``rows_per_file`` rows (0: one per task)."""
        base = self.version()
        return self._commit(base, self.shards(base) + self._write(df, rows_per_file), df.schema.json())

    def compact(self) -> int:
        """Merge tiers until none below the target holds ``fan_in`` runs; returns the newest version."""
        while True:
            base = self.version()
            old = self.shards(base)
            tiers: dict[int, list[Shard]] = {}
            for s in old:
                if s.bytes < self.target // 2:
                    tiers.setdefault(s.tier, []).append(s)
            full = {t: x for t, x in tiers.items() if len(x) >= self.fan_in}
            if not full:
                return base
            merged: DataFrame | None = None
            for _, group in sorted(full.items()):
                size = sum(s.bytes for s in group)
                files = max(1, min(len(group) // self.fan_in, math.ceil(len(group) / self.fan_in)), math.ceil(size / self.target))
                one = self._read(group).coalesce(files)
                merged = one if merged is None else merged.unionByName(one)
            gone = {s.name for group in full.values() for s in group}
            new = self._write(merged)
            self._commit(base, [s for s in old if s.name not in gone] + new, self.schema())

    def vacuum(self, older_than_s: float = 0.0) -> int:
        """Delete shards that the newest version does not name and that are at least so old; how many.

        Beside running writers choose an age above that of their longest write: what they have not committed
        yet is not named either.
        """
        named, n = {s.name for s in self.shards()}, 0
        before = (time.time() - older_than_s) * 1000
        for run, _ in self._list("data"):
            if self._fs.getFileStatus(self._p(f"data/{run}")).getModificationTime() > before:
                continue
            files = [f for f, _ in self._list(f"data/{run}") if f.endswith(".parquet")]
            for f in files:
                if f"{run}/{f}" not in named:
                    self._fs.delete(self._p(f"data/{run}/{f}"), False)
                    n += 1
            if not any(f"{run}/{f}" in named for f in files):
                self._fs.delete(self._p(f"data/{run}"), True)
        return n

    # Readers

    def _read(self, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.schema()))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.shards(version))


def shard_documents(docs: DataFrame, target_bytes: int = 32 << 20, fan_in: int = 4, rows_per_file: int = 1000) -> DataFrame:
    """Store all ``docs``, compact, and read the newest version back.

    Returns per document: doc_id, n_bytes (UTF-8, null for null text), text_sha256, shard, shard_tier.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch_path(spark, "shards"), target_bytes, fan_in, target_bytes // fan_in**3)
    store.append(docs, rows_per_file)
    store.compact()
    store.vacuum()
    size = F.col("_metadata.file_size")
    tiers = [F.when(size >= store.small * fan_in**i, F.lit(1)).otherwise(F.lit(0)) for i in range(16)]
    return store.read().select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2)).alias("shard"),
        sum(tiers[1:], tiers[0]).cast("int").alias("shard_tier"),
    )
