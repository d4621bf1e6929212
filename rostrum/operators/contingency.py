"""Correspondence analysis of a contingency table.

Counting and trimming are distributed; the table itself is categories by categories, checked against
``MAX_CELLS`` before it is collected for the singular value decomposition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 4_000_000


def trim(counts: DataFrame, row: str, col: str, n: str, min_row: int = 3, min_col: int = 2) -> DataFrame:
    """Cells whose row and column totals (before trimming) reach the minimum."""
    r = counts.groupBy(row).agg(F.sum(n).alias("row_total")).where(F.col("row_total") >= min_row)
    c = counts.groupBy(col).agg(F.sum(n).alias("col_total")).where(F.col("col_total") >= min_col)
    return counts.join(r, row).join(c, col)


@dataclass
class Correspondence:
    rows: list
    cols: list
    row_coords: np.ndarray
    col_coords: np.ndarray
    inertia: np.ndarray
    row_mass: np.ndarray
    col_mass: np.ndarray


def correspondence(table: np.ndarray, rows: list, cols: list) -> Correspondence | None:
    """Principal coordinates and shares of inertia; None below 3 x 3. Signs: the largest row coordinate is positive."""
    table = np.asarray(table, float)
    keep_r, keep_c = table.sum(axis=1) > 0, table.sum(axis=0) > 0
    table = table[keep_r][:, keep_c]
    rows, cols = [x for x, k in zip(rows, keep_r, strict=True) if k], [x for x, k in zip(cols, keep_c, strict=True) if k]
    if min(table.shape) < 3:
        return None
    p = table / table.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    k = max(2, min(table.shape) - 1)
    u, s, v = u[:, :k], s[:k], vt[:k].T
    f, g = u * s / np.sqrt(r)[:, None], v * s / np.sqrt(c)[:, None]
    sign = np.sign(f[np.abs(f).argmax(axis=0), np.arange(k)])
    sign[sign == 0] = 1
    share = s**2 / (s**2).sum() if (s**2).sum() else s
    return Correspondence(rows, cols, f * sign, g * sign, share, r, c)


def analyse(counts: DataFrame, row: str, col: str, n: str, **limits) -> Correspondence | None:
    t = trim(counts, row, col, n, **limits)
    if t.select(row).distinct().count() * t.select(col).distinct().count() > MAX_CELLS:
        raise ValueError("too many categories for a correspondence analysis")
    cells = t.groupBy(row, col).agg(F.sum(n).alias("n")).collect()
    rows, cols = sorted({x[0] for x in cells}), sorted({x[1] for x in cells})
    m = np.zeros((len(rows), len(cols)))
    place_r, place_c = ({x: i for i, x in enumerate(names)} for names in (rows, cols))
    for a, b, k in cells:
        m[place_r[a], place_c[b]] = k
    return correspondence(m, rows, cols)


def align(coords: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Signs per axis: +1 or -1, so that coordinates point as those of a reference."""
    s = np.sign((coords * reference).sum(axis=0))
    return np.where(s == 0, 1, s)
