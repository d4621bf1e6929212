"""Sinks: nested and partitioned JSON, compact points, documents, features, tiles and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import first_seen_ids


def write_partitioned_json(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per key, so a reader of one topic or debate opens only that one.

    Rows are rebalanced by key: small keys share a task, a large one is split over several files.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").json(path)


def anchors(clusters: DataFrame, cluster: str, vec: str) -> DataFrame:
    """cluster, size and mean vector (5 digits) by which a later run finds the clusters of this one again."""
    parts = clusters.select(cluster, F.posexplode(vec).alias("pos", "v"))
    mean = parts.groupBy(cluster, "pos").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("v"), F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "v")))  # as many as a vector has components
    return mean.groupBy(cluster).agg(F.max("n").alias("size"), F.transform(rows, lambda r: r["v"]).alias("mean_vector"))


def write_anchors(clusters: DataFrame, path: str, cluster: str, key: str, vec: str) -> None:
    """Two Parquet folders: ``anchors`` (one row a cluster) and ``members`` (cluster, key)."""
    anchors(clusters, cluster, vec).write.option("compression", "zstd").parquet(f"{path}/anchors")
    clusters.select(cluster, key).write.option("compression", "zstd").parquet(f"{path}/members")


def lean(df: DataFrame, drop: list[str]) -> DataFrame:
    """Without fields, nested ones as a.b."""
    for d in drop:
        if "." in d:
            col, _, field = d.partition(".")
            df = df.withColumn(col, F.col(col).dropFields(field))
        else:
            df = df.drop(d)
    return df


def compact_points(points: DataFrame, dims: list[str], seq: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows as arrays of [x, y, dimension ids ...] and one dictionary per dimension, ids by first appearance.

    Rows without finite coordinates are left out.
    """
    ok = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    out, tables = ok, {}
    for d in dims:
        tables[d] = first_seen_ids(ok, d, seq, f"{d}_id")
        out = out.join(F.broadcast(tables[d]) if tables[d].count() <= 100_000 else tables[d], d, "left")
    row = F.array(F.round("x", 4), F.round("y", 4), *[F.col(f"{d}_id").cast("double") for d in dims])
    return out.select(seq, row.alias("row")), tables


def guard_size(df: DataFrame, column: str, most: int) -> int:
    """Total bytes of a column's JSON; an error above ``most``."""
    total = df.agg(F.sum(F.octet_length(F.to_json(F.struct(column))))).first()[0] or 0
    if total > most:
        raise ValueError(f"{total} bytes exceed {most}")
    return total


def markdown(df: DataFrame, group: str, stance: str, quote: str, who: str) -> DataFrame:
    """One Markdown document per group: headings per stance, quotes with their speaker."""
    item = F.format_string("- “%s” — %s", F.col(quote), F.col(who))
    s = df.groupBy(group, stance).agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("items"))
    part = F.concat(F.lit("## "), F.col(stance), F.lit("\n"), F.col("items"))
    return s.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(part)), "\n\n").alias("document"))


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    props = F.struct(*[c.alias(n) for n, c in properties.items()]) if properties else F.create_map()
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))


def point_geometry(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def ring_geometry(xs: Column, ys: Column) -> Column:
    pts = F.zip_with(xs, ys, lambda a, b: F.array(a, b))
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(pts, F.slice(pts, 1, 1))).alias("coordinates"))


def tile_payloads(shown: DataFrame) -> DataFrame:
    """z, tx, ty, n, payload: the points of each tile as JSON bytes, in order of rank.

    A tile holds a bounded number of points (see ``spatial.thin``), so collecting one is bounded too.
    """
    p = shown.groupBy("z", "tx", "ty").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")))).alias("p"), F.count("*").alias("n"))
    return p.select("z", "tx", "ty", "n", F.to_json(F.transform("p", lambda e: F.array(e["id"].cast("double"), e["x"], e["y"]))).cast("binary").alias("payload"))


def append_parts(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the Parquet folder does not hold yet (incremental caches)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").option("compression", "zstd").parquet(path)
