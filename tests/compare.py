"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

import datetime
import decimal
import math
import os

import duckdb

from rostrum.catalog import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(df):
    """Coarse types by name: what a value hash sees."""
    out = {}
    for n, t in df.dtypes:
        t = "int" if t in ("int", "bigint", "smallint", "tinyint") else "float" if t in ("double", "float") or t.startswith("decimal") else t
        out[n] = t
    return out


def compare(spark, con, sf_dir, query, sql):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = normal([c[0] for c in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, not {len(want[1])}; first {got[1][:2]} and {want[1][:2]}"
    for g, w in zip(got[1], want[1], strict=True):
        if g != w and not all(a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) for a, b in zip(g, w, strict=True)):
            return f"{g} and {w}"
    return None
