"""Dates and times as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_offset(local: Column, zone: str = "Europe/Amsterdam") -> Column:
    """Offset of a naive local time as +hh:mm, with summer time."""
    utc = F.to_utc_timestamp(local.cast("timestamp"), zone)
    minutes = ((F.unix_timestamp(local.cast("timestamp")) - F.unix_timestamp(utc)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    m = F.abs(minutes)
    return F.concat(sign, F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def iso_with_offset(local: Column, zone: str = "Europe/Amsterdam") -> Column:
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), utc_offset(local, zone))


def url_time(local: Column, zone: str = "Europe/Amsterdam") -> Column:
    """The same, percent-encoded for a query string."""
    return F.url_encode(iso_with_offset(local, zone))


def thumbnail_path(local: Column, seconds: Column) -> Column:
    """yyyy/MM/dd/HH-mm-ss of the time ``seconds`` later, over midnight too."""
    t = F.timestamp_seconds(F.unix_timestamp(local.cast("timestamp")) + F.floor(seconds))
    return F.date_format(t, "yyyy/MM/dd/HH-mm-ss")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def parse_day(text: Column) -> Column:
    """d m y with -, / or . between; null for anything else."""
    p = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\s*$"
    day = F.concat_ws("-", *[F.lpad(F.regexp_extract(text, p, i), n, "0") for i, n in ((3, 4), (2, 2), (1, 2))])
    return F.when(text.rlike(p), F.try_to_date(day))


def event_type(turn: Column, chair: Column) -> Column:
    """Which event starts a turn; null for kinds that have none."""
    return F.when(chair, "chair").when(turn == "interruption", "interrupt").when(turn == "speech", "speak")


def clip_window(start: Column, end: Column, lead: float = 1.5, least: float = 8, most: float = 18) -> tuple[Column, Column]:
    """(begin, duration): a little early, never before 0, of bounded length."""
    a = F.greatest(start - lead, F.lit(0.0))
    return a, F.greatest(F.lit(least), F.least(F.lit(most), end - a))
