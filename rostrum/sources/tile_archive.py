"""Archives of map tiles in one byte space (the public PMTiles format, version 3), written and scanned in parallel.

The byte space is header, root directory, metadata, leaf directories and tile data.  A folder holds it as files in that order,
``head.bin``, one ``leaves-N.bin`` and one ``data-N.bin`` per range of tiles, so tasks write side by side; ``parts.json``, written
last, lists them and is the commit.  ``join_parts`` copies the files of a folder behind one another: the single-file archive.

Writing: tiles get their number along the Hilbert curve, a range exchange orders them, runs of equal tiles count once, and sums over
the ranges before it tell each range where its bytes begin; then every task writes its data and the leaf directories over it.

Scanning (``read_archive``): the root directory is read on the driver, its leaves are dealt out as partitions; filters on the
zoom level leave out the leaves of other levels.

Edge cases: null payloads are no tiles; an archive without tiles has an empty root; two payloads for one tile are refused.
"""

from __future__ import annotations

import gzip
import json
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import scratch

#: The format's fixed values: header length, where the first tile of each zoom level is numbered.
HEADER = 127
FIRST = [(4**z - 1) // 3 for z in range(28)]
#: Entries of one leaf directory.
LEAF = 4096


def tile_number(z: Column, x: Column, y: Column) -> Column:
    """The tile's number: all tiles of lower zoom levels, then its place on the Hilbert curve of its level."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = s["x"].bitwiseAND(side) != 0, s["y"].bitwiseAND(side) != 0
        part = F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0)
        turn = lambda v: F.when(rx, side - 1 - v.bitwiseAND(side - 1)).otherwise(v.bitwiseAND(side - 1))
        return F.struct(
            F.when(ry, s["x"]).otherwise(turn(s["y"])).alias("x"), F.when(ry, s["y"]).otherwise(turn(s["x"])).alias("y"), (s["d"] + side * side * part).alias("d")
        )

    bits = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.get(F.array(*[F.lit(v) for v in FIRST]), z.cast("int")) + F.aggregate(bits, start, step, lambda s: s["d"])


def tile_of(number: int) -> tuple[int, int, int]:
    """(z, x, y) of a tile's number."""
    z = bisect_right(FIRST, number) - 1
    d, x, y = number - FIRST[z], 0, 0
    for k in range(z):
        side = 1 << k
        rx, ry = d >> 1 & 1, (d ^ d >> 1) & 1
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y, d = x + side * rx, y + side * ry, d >> 2
    return z, x, y


def _varints(values) -> bytes:
    out = bytearray()
    for v in values:
        v = int(v)
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _read_varints(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v = shift = 0
    return out


def pack_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries (number, run, offset, length) as differences of variable length, compressed; run 0 points to a leaf."""
    numbers = [e[0] for e in entries]
    offsets = [0 if i and e[2] == entries[i - 1][2] + entries[i - 1][3] else e[2] + 1 for i, e in enumerate(entries)]
    body = [len(entries), *np.diff([0, *numbers]).tolist(), *[e[1] for e in entries], *[e[3] for e in entries], *offsets]
    return gzip.compress(_varints(body), mtime=0)


def unpack_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    v = _read_varints(gzip.decompress(data))
    n = v[0]
    numbers, runs, lengths, offsets = np.cumsum(v[1 : n + 1]).tolist(), v[n + 1 : 2 * n + 1], v[2 * n + 1 : 3 * n + 1], v[3 * n + 1 :]
    out = []
    for i in range(n):
        at = offsets[i] - 1 if offsets[i] else out[-1][2] + out[-1][3]
        out.append((int(numbers[i]), runs[i], at, lengths[i]))
    return out


@dataclass
class Header:
    root: tuple[int, int]
    metadata: tuple[int, int]
    leaves: tuple[int, int]
    data: tuple[int, int]
    counts: tuple[int, int, int]
    zooms: tuple[int, int]
    bounds: tuple[float, float, float, float]

    def pack(self) -> bytes:
        e7 = [round(v * 10_000_000) for v in self.bounds]
        centre = [round((self.bounds[i] + self.bounds[i + 2]) / 2 * 10_000_000) for i in (0, 1)]
        words = np.array([*self.root, *self.metadata, *self.leaves, *self.data, *self.counts], "<u8").tobytes()
        # Tiles in order of their numbers; directories and tiles compressed by gzip; vector tiles.
        kinds = bytes([1, 2, 2, 1, *self.zooms])
        return b"PMTiles\x03" + words + kinds + np.array(e7, "<i4").tobytes() + bytes([self.zooms[0]]) + np.array(centre, "<i4").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Header:
        if data[:8] != b"PMTiles\x03" or len(data) < HEADER:
            raise ValueError("not a tile archive of version 3")
        w = np.frombuffer(data[8:96], "<u8").tolist()
        e7 = (np.frombuffer(data[102:118], "<i4") / 10_000_000).tolist()
        return Header((w[0], w[1]), (w[2], w[3]), (w[4], w[5]), (w[6], w[7]), tuple(w[8:11]), (data[100], data[101]), tuple(e7))


class ArchiveSink(DataSource):
    """``df.write.format("tile_archive")``; written through :func:`write_archive`, which puts the rows in order."""

    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return "z int, x long, y long, payload binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    #: (part, leaf file, its length, data file, its length, [(first number, offset in the leaf file, length)], tiles, entries)
    parts: list[tuple]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        """Rows (part, base, number, payload, fresh), in order of part and number; ``base``: bytes of the parts before."""
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.options["path"])
        attempt = TaskContext.get().taskAttemptId()
        done, part, data, entries, at, tiles = [], None, None, [], 0, 0

        def close():
            if part is None:
                return
            data.close()
            name = f"leaves-{part:06d}-{attempt}.bin"
            size, index = 0, []
            with store.open_output_stream(f"{root}/{name}") as out:
                for i in range(0, len(entries), LEAF):
                    packed = pack_directory([tuple(e) for e in entries[i : i + LEAF]])
                    index.append((entries[i][0], size, len(packed)))
                    out.write(packed)
                    size += len(packed)
            done.append((part, name, size, f"data-{part:06d}-{attempt}.bin", at, index, tiles, len(entries)))

        for row in iterator:
            if row.part != part:
                close()
                part, entries, at, tiles = row.part, [], 0, 0
                data = store.open_output_stream(f"{root}/data-{part:06d}-{attempt}.bin")
            tiles += 1
            if row.fresh or not entries:
                data.write(bytes(row.payload))
                entries.append([row.number, 1, row.base + at, len(row.payload)])
                at += len(row.payload)
            else:
                entries[-1][1] += 1
        close()
        return _Written(done)

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.options["path"])
        parts = sorted(p for m in messages if m for p in m.parts)
        leaf_at = np.cumsum([0, *[p[2] for p in parts]]).tolist()
        index = [(number, 0, base + at, size) for p, base in zip(parts, leaf_at, strict=False) for number, at, size in p[5]]
        directory = pack_directory(index)
        metadata = gzip.compress(self.options["metadata"].encode(), mtime=0)
        head = HEADER + len(directory) + len(metadata)
        header = Header(
            (HEADER, len(directory)), (HEADER + len(directory), len(metadata)), (head, leaf_at[-1]), (head + leaf_at[-1], sum(p[4] for p in parts)),
            (sum(p[6] for p in parts), sum(p[7] for p in parts), sum(p[7] for p in parts)), tuple(json.loads(self.options["zooms"])), tuple(json.loads(self.options["bounds"])),
        )
        with store.open_output_stream(f"{root}/head.bin") as out:
            out.write(header.pack() + directory + metadata)
        files = [("head.bin", head), *[(p[1], p[2]) for p in parts], *[(p[3], p[4]) for p in parts]]
        with store.open_output_stream(f"{root}/parts.json.new") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{root}/parts.json.new", f"{root}/parts.json")

    def abort(self, messages):
        """Files without a ``parts.json`` are no archive."""


def write_archive(tiles: DataFrame, path: str, bounds: tuple[float, float, float, float], metadata: dict | None = None, ranges: int | None = None) -> None:
    """Write tiles (z, x, y, payload) as an archive in the new folder ``path``; ``bounds``: west, south, east, north in degrees."""
    spark = tiles.sparkSession
    spark.dataSource.register(ArchiveSink)

    @F.pandas_udf("binary")
    def squeeze(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: gzip.compress(bytes(b), mtime=0))

    rows = tiles.where("payload IS NOT NULL").select(tile_number(F.col("z"), F.col("x"), F.col("y")).alias("number"), "z", squeeze("payload").alias("payload"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = scratch(rows.repartitionByRange(n, "number").withColumn("part", F.spark_partition_id()), "tiles")
    before = Window.partitionBy("part").orderBy("number")
    digest = F.sha2("payload", 256)
    runs = staged.select("part", "number", "payload", F.lag("number").over(before).alias("last"), F.coalesce(F.lag(digest).over(before) == digest, F.lit(False)).alias("same"))
    if not runs.where("number = last").isEmpty():
        raise ValueError("two payloads for one tile")
    runs = runs.withColumn("fresh", ~(F.col("same") & (F.col("number") == F.coalesce("last", F.lit(-2)) + 1)))
    sizes = runs.groupBy("part").agg(F.sum(F.when(F.col("fresh"), F.octet_length("payload")).otherwise(0)).alias("bytes"))
    # One row per range: the bytes of all ranges before it.
    base = sizes.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("base"))
    z = staged.agg(F.min("z"), F.max("z")).first()
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    out = runs.join(F.broadcast(base), "part").select("part", "base", "number", "payload", "fresh")
    (
        out.repartition(n, "part").sortWithinPartitions("part", "number")
        .write.format("tile_archive").mode("append")
        .option("path", path).option("bounds", json.dumps(bounds)).option("zooms", json.dumps([z[0] or 0, z[1] or 0])).option("metadata", json.dumps(metadata or {}))
        .save()
    )


class Archive:
    """The byte space of a folder's files, or of one file."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path)
        info = self.store.get_file_info(self.root)
        if info.is_file:
            self.files = [(self.root, info.size)]
        else:
            with self.store.open_input_stream(f"{self.root}/parts.json") as f:
                self.files = [(f"{self.root}/{name}", size) for name, size in json.loads(f.read())]
        self.starts = np.cumsum([0, *[s for _, s in self.files]]).tolist()

    def read(self, at: int, size: int) -> bytes:
        out = b""
        while size > 0:
            i = bisect_right(self.starts, at) - 1
            if i >= len(self.files):
                raise EOFError("the archive ends before its directory says")
            with self.store.open_input_file(self.files[i][0]) as f:
                got = f.read_at(min(size, self.starts[i + 1] - at), at - self.starts[i])
            out, at, size = out + got, at + len(got), size - len(got)
        return out

    def header(self) -> Header:
        return Header.unpack(self.read(0, HEADER))

    def metadata(self) -> dict:
        return json.loads(gzip.decompress(self.read(*self.header().metadata)))


@dataclass
class _Leaf(InputPartition):
    entries: list[tuple[int, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.low, self.high = 0, len(FIRST) - 2

    def pushFilters(self, filters):
        for f in filters:
            on, v = getattr(f, "attribute", None), getattr(f, "value", None)
            if on == ("z",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and v is not None:
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, v)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, v)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, v + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, v - 1)
            elif on == ("z",) and isinstance(f, In) and f.value:
                self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
                yield f  # levels between those asked for are left to Spark
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.low > self.high:
            return []
        a = Archive(self.options["path"])
        h = a.header()
        root = unpack_directory(a.read(*h.root))
        first, last = FIRST[self.low], FIRST[self.high + 1]
        ends = [*[e[0] for e in root[1:]], FIRST[-1]]
        kept = [e for e, end in zip(root, ends, strict=False) if e[0] < last and end > first]
        most = int(self.options.get("leaves", 1))
        return [_Leaf(kept[i : i + most]) for i in range(0, len(kept), most)]

    def read(self, partition: _Leaf | None):
        if partition is None:  # what Spark hands over where there are no partitions
            return
        a = Archive(self.options["path"])
        h = a.header()
        first, last = FIRST[self.low], FIRST[self.high + 1]
        for number, run, at, size in partition.entries:
            entries = [(number, run, at, size)] if run else unpack_directory(a.read(h.leaves[0] + at, size))
            entries = [e for e in entries if e[0] < last and e[0] + e[1] > first]
            for i in range(0, len(entries), 64):  # neighbours in number are neighbours in the data
                group = entries[i : i + 64]
                low, high = min(e[2] for e in group), max(e[2] + e[3] for e in group)
                near = high - low <= 2 * sum(e[3] for e in group)
                block = a.read(h.data[0] + low, high - low) if near else None
                for n, r, o, s in group:
                    payload = block[o - low : o - low + s] if near else a.read(h.data[0] + o, s)
                    for k in range(n, n + r):
                        if first <= k < last:
                            yield (*tile_of(k), gzip.decompress(payload))


def read_archive(spark, path: str) -> DataFrame:
    """z, x, y, payload of all tiles of a folder or file. Sets the session to hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSink)
    return spark.read.format("tile_archive").load(path)


def join_parts(path: str, target: str, block: int = 8 << 20) -> None:
    """Copy a folder's files behind one another into the single file ``target``, block by block."""
    a = Archive(path)
    store, name = fs.FileSystem.from_uri(target)
    with store.open_output_stream(name) as out:
        for f, size in a.files:
            with a.store.open_input_stream(f) as part:
                while size:
                    got = part.read(min(block, size))
                    out.write(got)
                    size -= len(got)
