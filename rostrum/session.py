"""Sessions and shared scratch space.

Everything that cuts lineage goes through :func:`scratch`: it writes Parquet below the folder
named by ``spark.checkpoint.dir`` (shared by driver and executors on a cluster), so a lost
executor never loses it.  Where that setting is missing a local master gets a local folder; a cluster is refused.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rostrum", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects; on a cluster use the cluster's own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set to a local one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = os.path.join(tempfile.gettempdir(), f"rostrum-{os.getpid()}")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        named = "file://" + local
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths of :func:`scratch` that nobody deleted yet, in order.
MADE: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rostrum/{tag}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    MADE.append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rostrum_path = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Delete the files behind frames of :func:`scratch` that nothing reads any more."""
    for df in frames:
        drop_path(df.sparkSession, getattr(df, "_rostrum_path", None))


def drop_path(spark: SparkSession, path: str | None) -> None:
    if path in MADE:
        MADE.remove(path)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
