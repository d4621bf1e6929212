"""Numbers, vectors and geometry as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(n: Column, total: Column, digits: int = 1) -> Column:
    """Share in percent, half up; 0 without a total."""
    k = 10**digits
    return F.when(total == 0, F.lit(0.0)).otherwise(F.floor(100.0 * k * F.try_divide(n, total) + 0.5) / k)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def nice_ceiling(x: Column) -> Column:
    """The next of 1, 2, 2.5, 5, 10 times a power of ten; 1 for x <= 0."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(x, F.lit(1e-12)))))
    r = x / p
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.when(r <= 1, 1.0).when(r <= 2, 2.0).when(r <= 2.5, 2.5).when(r <= 5, 5.0).otherwise(10.0) * p)


def sqrt_width(value: Column, top: Column) -> Column:
    """Bar width in percent by square root; 0 where top <= 0."""
    return F.when(top <= 0, F.lit(0.0)).otherwise(100 * F.sqrt(F.try_divide(value.cast("double"), top)))


def tile(x: Column, y: Column, zoom: Column, lo: float, hi: float) -> tuple[Column, Column]:
    """Tile column and row of a point in the square [lo, hi], clamped to the grid."""
    n = F.pow(F.lit(2.0), zoom)
    at = lambda v: F.least(F.greatest(F.floor((v - lo) / (hi - lo) * n), F.lit(0)), n - 1).cast("int")
    return at(x), at(F.lit(hi) - y + lo)


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of spherical Mercator metres."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (D65) to sRGB in 0..255."""
    fy = (lightness + 16) / 116
    inv = lambda t: F.when(t > 6 / 29, t * t * t).otherwise(3 * (6 / 29) ** 2 * (t - 4 / 29))
    x, y, z = 0.95047 * inv(fy + a / 500), inv(fy), 1.08883 * inv(fy - b / 200)
    lin = (3.2404542 * x - 1.5371385 * y - 0.4985314 * z, -0.969266 * x + 1.8760108 * y + 0.041556 * z, 0.0556434 * x - 0.2040259 * y + 1.0572252 * z)
    enc = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), 1 / 2.4) - 0.055)
    return tuple(F.round(255 * F.least(F.greatest(enc(v), F.lit(0.0)), F.lit(1.0))).cast("int") for v in lin)


def point_radius(density: Column, target: float, least: float, most: float) -> Column:
    """Radius that gives ``target`` ink at this density, clamped."""
    return F.least(F.greatest(F.sqrt(F.try_divide(F.lit(target), math.pi * density)), F.lit(least)), F.lit(most))


def uniform_from_id(key: Column, seed: int = 0) -> Column:
    """A repeatable number in (0, 1] per key: 52 bits of the MD5 of seed and key, so SQL can repeat it."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + 1) / float(1 << 52)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Signed area of a ring (shoelace)."""
    n = F.size(xs)
    nxt = lambda a: F.concat(F.slice(a, 2, n), F.slice(a, 1, 1))
    cross = F.zip_with(F.zip_with(xs, nxt(ys), lambda p, q: p * q), F.zip_with(nxt(xs), ys, lambda p, q: p * q), lambda p, q: p - q)
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2
