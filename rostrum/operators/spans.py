"""Evaluation of character spans by interval algebra: arrays of struct(start, end), half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= F.try_element_at(acc, F.lit(-1))["end"], grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def common(a: Column, b: Column) -> Column:
    """Characters in both of two merged arrays."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.aggregate(b, F.lit(0).cast("long"), lambda m, y: m + F.greatest(F.lit(0).cast("long"), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))))


def char_outcomes(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """True positive, false positive and false negative characters."""
    p, g = merged(predicted), merged(gold)
    both = common(p, g)
    return both, total(p) - both, total(g) - both
