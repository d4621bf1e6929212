"""Tile archives: written and read back, single file, headers, runs, filters, failed writes; and vector tiles."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.sources import tile_archive, vector_tiles

TILES = "z int, x long, y long, payload binary"


def test_numbers_along_the_curve(spark):
    rows = [(z, x, y) for z in range(6) for x in range(2**z) for y in range(2**z)]
    got = spark.createDataFrame(rows, "z int, x long, y long").select("z", "x", "y", tile_archive.tile_number(F.col("z"), F.col("x"), F.col("y")).alias("n")).collect()
    number = {(r.z, r.x, r.y): r.n for r in got}
    assert sorted(number.values()) == list(range(len(rows)))
    assert all(tile_archive.tile_of(n) == t for t, n in number.items())
    assert [number[1, x, y] for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]  # as the format prescribes
    for z in range(1, 6):  # neighbours on the curve are neighbours on the map
        own = sorted((n, x, y) for (k, x, y), n in number.items() if k == z)
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(own, own[1:], strict=False))
    big = spark.range(1).select(tile_archive.tile_number(F.lit(20), F.lit(1000003), F.lit(7)).alias("n")).first().n
    assert tile_archive.tile_of(big) == (20, 1000003, 7)


def test_directories():
    entries = [(0, 1, 0, 10), (5, 3, 10, 70000), (9, 1, 0, 10), (10**9, 0, 12345, 300)]
    assert tile_archive.unpack_directory(tile_archive.pack_directory(entries)) == entries
    assert tile_archive.unpack_directory(tile_archive.pack_directory([])) == []


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(z, x, y, b"same" if x < 2**z // 2 else f"{z}/{x}/{y}".encode() * 9) for z in range(5) for x in range(2**z) for y in range(2**z) if (x + y) % 5]
    path = f"file://{tmp_path_factory.mktemp('tiles')}/archive"
    tile_archive.write_archive(spark.createDataFrame(rows, TILES).repartition(7), path, (-10.5, 40.25, 11.0, 60.0), {"name": "t"}, ranges=3)
    return path, rows


def rows_of(df):
    return sorted((r.z, r.x, r.y, bytes(r.payload)) for r in df.collect())


def test_read_back_and_header(spark, written):
    path, rows = written
    assert rows_of(tile_archive.read_archive(spark, path)) == sorted(rows)
    a = tile_archive.Archive(path)
    h = a.header()
    assert h.bounds == (-10.5, 40.25, 11.0, 60.0) and h.zooms == (1, 4) and a.metadata() == {"name": "t"}
    assert h.counts[0] == len(rows) > h.counts[1]  # equal neighbours are one entry
    assert h.data[0] + h.data[1] == a.starts[-1]


def test_single_file_holds_the_same_tiles(spark, written, tmp_path):
    path, rows = written
    one = f"file://{tmp_path}/one.pmtiles"
    tile_archive.join_parts(path, one, block=100)
    assert rows_of(tile_archive.read_archive(spark, one)) == sorted(rows)
    raw = (tmp_path / "one.pmtiles").read_bytes()
    h = tile_archive.Header.unpack(raw)
    # By the format alone: the root names leaves, a leaf names tiles.
    root = tile_archive.unpack_directory(raw[h.root[0] : sum(h.root)])
    seen = {}
    for number, run, at, size in root:
        assert run == 0
        leaf = tile_archive.unpack_directory(raw[h.leaves[0] + at : h.leaves[0] + at + size])
        assert leaf[0][0] == number
        for n, r, o, s in leaf:
            for k in range(n, n + r):
                seen[tile_archive.tile_of(k)] = gzip.decompress(raw[h.data[0] + o : h.data[0] + o + s])
    assert seen == {r[:3]: r[3] for r in rows}
    assert json.loads(gzip.decompress(raw[h.metadata[0] : sum(h.metadata)])) == {"name": "t"}


def test_filters_leave_out_leaves(spark, written):
    path, rows = written
    reader = tile_archive._Reader({"path": path})
    every = len(reader.partitions())
    from pyspark.sql.datasource import EqualTo, In, LessThan

    assert list(reader.pushFilters([EqualTo(("z",), 1), EqualTo(("x",), 0)])) == [EqualTo(("x",), 0)]
    assert len(reader.partitions()) < every
    other = tile_archive._Reader({"path": path})
    assert list(other.pushFilters([In(("z",), (1, 3)), LessThan(("z",), 4)])) == [In(("z",), (1, 3))]
    df = tile_archive.read_archive(spark, path)
    assert rows_of(df.where("z = 2")) == sorted(r for r in rows if r[0] == 2)
    assert rows_of(df.where("z in (1, 3) and x = 0")) == sorted(r for r in rows if r[0] in (1, 3) and r[1] == 0)
    assert rows_of(df.where("z > 1 and z < 3")) == sorted(r for r in rows if r[0] == 2)
    assert df.where("z > 9").count() == 0


def test_small_leaves(spark, monkeypatch, tmp_path):
    rows = [(4, x, y, f"{x}-{y}".encode()) for x in range(16) for y in range(16)]
    entries = [(n, 1, n * 5, 5) for n in range(300)]
    assert tile_archive.unpack_directory(tile_archive.pack_directory(entries)) == entries
    path = f"file://{tmp_path}/a"
    tile_archive.write_archive(spark.createDataFrame(rows, TILES), path, (0, 0, 1, 1), ranges=5)
    assert len(tile_archive._Reader({"path": path}).partitions()) == 5
    assert len(tile_archive._Reader({"path": path, "leaves": "3"}).partitions()) == 2
    assert rows_of(tile_archive.read_archive(spark, path)) == sorted(rows)


def test_empty_null_double_and_broken(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    tile_archive.write_archive(spark.createDataFrame([(0, 0, 0, None)], TILES), path, (0, 0, 1, 1))
    assert tile_archive.read_archive(spark, path).count() == 0
    with pytest.raises(ValueError, match="two payloads"):
        tile_archive.write_archive(spark.createDataFrame([(0, 0, 0, b"a"), (0, 0, 0, b"b")], TILES), f"file://{tmp_path}/two", (0, 0, 1, 1))
    os.mkdir(tmp_path / "part")  # data without a commit is no archive
    (tmp_path / "part" / "data-000000-1.bin").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        tile_archive.Archive(f"file://{tmp_path}/part")
    with pytest.raises(ValueError, match="not a tile archive"):
        tile_archive.Header.unpack(b"x" * 200)


def test_vector_tiles(spark):
    rng = np.random.default_rng(1)
    ids, xs, ys = [int(v) for v in rng.integers(0, 2**60, 50)], rng.integers(-5, 4101, 50).tolist(), rng.integers(0, 4096, 50).tolist()
    assert vector_tiles.decode_points(vector_tiles.encode_points(ids, xs, ys)) == (ids, xs, ys, 4096)
    assert vector_tiles.decode_points(vector_tiles.encode_points(ids, xs, ys, name="other")) == ([], [], [], 4096)
    assert vector_tiles.decode_points(b"") == ([], [], [], 4096)
    # A multi-point feature as another writer would put it: two points, the second relative to the first.
    spot = bytes([1 | 2 << 3, 10, 10, 4, 3])
    layer = vector_tiles._field(1, b"points") + vector_tiles._field(2, bytes([8, 7, 24, 1]) + vector_tiles._field(4, spot)) + bytes([5 << 3, 100, 15 << 3, 2])
    assert vector_tiles.decode_points(vector_tiles._field(3, layer)) == ([7, 7], [5, 7], [5, 3], 100)


def test_points_through_an_archive(spark, tmp_path):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-10, 10, (300, 2)))]
    from rostrum.functions.maths import tile

    df = spark.createDataFrame(pts, "id long, x double, y double").withColumn("z", F.explode(F.array(F.lit(0), F.lit(3))))
    tx, ty = tile(F.col("x"), F.col("y"), F.col("z"), -10.0, 10.0)
    path = f"file://{tmp_path}/points"
    tile_archive.write_archive(vector_tiles.point_tiles(df.withColumn("tx", tx).withColumn("ty", ty), -10.0, 10.0), path, (-1, -1, 1, 1))
    points = vector_tiles.tile_points(tile_archive.read_archive(spark, path))
    got = {(r.z, r.id): (r.x * 4096 + r.px, r.y * 4096 + r.py) for r in points.collect()}
    for i, x, y in pts:
        for z in (0, 3):
            n = 2**z * 4096
            assert np.allclose(got[z, i], (np.floor((x + 10) / 20 * n), np.floor((10 - y) / 20 * n)), atol=1)
    ink = {r.zoom: r for r in vector_tiles.ink_density(points).collect()}
    cells, counts = np.unique(np.array([(got[0, i][0] // 128, got[0, i][1] // 128) for i in range(300)]), axis=0, return_counts=True)
    assert ink[0].tiles == 1 and ink[0].points == 300 and ink[0].cells == len(cells)
    assert ink[0].per_px2_p90 == pytest.approx(np.percentile(counts, 90) / 256) and ink[0].per_px2_max == counts.max() / 256
