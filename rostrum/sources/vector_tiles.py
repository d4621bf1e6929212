"""Vector tiles with one layer of points (the public Mapbox Vector Tile format, version 2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tile_archive import _read_varints, _varints

EXTENT = 4096


def _field(number: int, data: bytes) -> bytes:
    return _varints([number << 3 | 2, len(data)]) + data


def encode_points(ids, xs, ys, name: str = "points", extent: int = EXTENT) -> bytes:
    """A tile of points with ids; coordinates count from the tile's upper left corner."""
    layer = _field(1, name.encode())
    for i, x, y in zip(ids, xs, ys, strict=True):
        spot = _varints([9, *[(v << 1) ^ (v >> 63) for v in (int(x), int(y))]])
        layer += _field(2, _varints([1 << 3, int(i), 3 << 3, 1]) + _field(4, spot))
    layer += _varints([5 << 3, extent, 15 << 3, 2])
    return _field(3, layer)


def _fields(data: bytes):
    """(number, value) of each field: an integer, or the bytes of a field with a length."""
    at = 0

    def varint():
        nonlocal at
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            if b < 128:
                return v
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            skip = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + skip]
            at += skip


def decode_points(tile: bytes, name: str = "points") -> tuple[list[int], list[int], list[int], int]:
    """(ids, xs, ys, extent) of the points of one layer; features of other kinds are passed over."""
    ids, xs, ys, extent = [], [], [], EXTENT
    for number, layer in _fields(tile):
        if number != 3:
            continue
        parts = list(_fields(layer))
        if dict(parts).get(1) != name.encode():
            continue
        extent = dict(parts).get(5, EXTENT)
        for kind, feature in parts:
            got = dict(_fields(feature)) if kind == 2 else {}
            if got.get(3) != 1:
                continue
            values = _read_varints(got[4])
            n, x, y = values[0] >> 3, 0, 0
            for k in range(n):
                x, y = x + _unzig(values[1 + 2 * k]), y + _unzig(values[2 + 2 * k])
                ids.append(got.get(1))
                xs.append(x)
                ys.append(y)
    return ids, xs, ys, extent


def _unzig(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def in_tile(x: Column, y: Column, zoom: Column, lo: float, hi: float, extent: int = EXTENT) -> tuple[Column, Column]:
    """Whole coordinates of a point of the square [lo, hi] inside its tile, from the upper left corner."""
    n = F.pow(F.lit(2.0), zoom)

    def at(share: Column) -> Column:
        whole = F.least(F.greatest(F.floor(share * n), F.lit(0)), n - 1)
        return F.least(F.greatest(F.floor((share * n - whole) * extent), F.lit(0)), F.lit(extent - 1)).cast("int")

    return at((x - lo) / (hi - lo)), at((F.lit(hi) - y) / (hi - lo))


def point_tiles(shown: DataFrame, lo: float, hi: float) -> DataFrame:
    """z, x, y, payload from shown points (z, tx, ty, id, x, y); a tile's points come in order of id.

    A tile holds as many points as the map's budget leaves in it (see ``spatial.thin``).
    """
    px, py = in_tile(F.col("x"), F.col("y"), F.col("z"), lo, hi)
    spots = shown.select("z", "tx", "ty", F.struct(F.col("id").cast("long").alias("id"), px.alias("px"), py.alias("py")).alias("p"))
    tiles = spots.groupBy("z", "tx", "ty").agg(F.sort_array(F.collect_list("p")).alias("ps"))

    @F.pandas_udf("binary")
    def encode(ps: pd.Series) -> pd.Series:
        return ps.map(lambda own: encode_points([p["id"] for p in own], [p["px"] for p in own], [p["py"] for p in own]))

    return tiles.select(F.col("z").cast("int").alias("z"), F.col("tx").cast("long").alias("x"), F.col("ty").cast("long").alias("y"), encode("ps").alias("payload"))


def tile_points(tiles: DataFrame) -> DataFrame:
    """z, x, y, id, px, py, extent of all points of tiles (z, x, y, payload)."""

    def run(batches):
        for b in batches:
            for z, x, y, payload in zip(*[b.column(c).to_pylist() for c in ("z", "x", "y", "payload")], strict=True):
                ids, xs, ys, extent = decode_points(payload)
                n = len(ids)
                cols = [np.full(n, v) for v in (z, x, y)] + [ids, xs, ys, np.full(n, extent)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return tiles.select("z", "x", "y", "payload").mapInArrow(run, "z int, x long, y long, id long, px int, py int, extent int")


_NAMES = ["z", "x", "y", "id", "px", "py", "extent"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def ink_density(points: DataFrame, tile_px: int = 512, cell_px: int = 16) -> DataFrame:
    """zoom, tiles, points, cells and the percentiles of points per square pixel over cells that hold any."""
    side = tile_px // cell_px
    cell = lambda c: F.least(F.floor(F.col(c) / F.col("extent") * side), F.lit(side - 1))
    n = points.groupBy("z", "x", "y", cell("px").alias("cx"), cell("py").alias("cy")).agg(F.count("*").alias("n"))
    area = float(cell_px * cell_px)
    p = lambda q: (F.percentile("n", F.lit(q)) / area).alias(f"per_px2_p{round(q * 100)}")
    tiles = n.groupBy("z").agg(F.count_distinct("x", "y").alias("tiles"))
    found = n.groupBy("z").agg(F.sum("n").alias("points"), F.count("*").alias("cells"), p(0.5), p(0.9), p(0.99), (F.max("n") / area).alias("per_px2_max"))
    return tiles.join(found, "z").withColumnRenamed("z", "zoom")
