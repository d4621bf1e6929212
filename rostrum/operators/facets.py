"""Faceted filtering: one declarative list of dimensions gives predicates, counts and validation.

A selection maps dimension names to chosen values: any value within a dimension (OR), all dimensions
together (AND).  The whole selection is one Column, so Catalyst pushes what it can into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """``values``: a scalar or array column of the row's values for this facet."""

    name: str
    values: Column
    many: bool = False

    def predicate(self, chosen: list) -> Column:
        if self.many:
            hit = F.arrays_overlap(self.values, F.array(*map(F.lit, chosen)))
        else:
            hit = self.values.isin(list(chosen))
        return F.coalesce(hit, F.lit(False))

    def as_array(self) -> Column:
        return F.array_distinct(self.values) if self.many else F.array(self.values)


def fold(text: Column) -> Column:
    """Text for searching: lower case without accents, under a collation that knows both."""
    return F.collate(text, "UNICODE_CI_AI")


def search(text: Column, terms: str) -> Column:
    """Every white-space separated term occurs somewhere, whatever its case and accents."""
    found = [F.contains(fold(text), fold(F.lit(t))) for t in terms.split()]
    return reduce(lambda a, b: a & b, found, F.lit(True))


def date_range(day: Column, first: str | None, last: str | None) -> Column:
    """Inclusive; a null day meets no active bound."""
    out = F.lit(True)
    if first:
        out = out & (day >= F.lit(first).cast("date"))
    if last:
        out = out & (day <= F.lit(last).cast("date"))
    return F.coalesce(out, F.lit(False))


def _labelled(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))


@dataclass(frozen=True)
class FacetQuery:
    dimensions: tuple[Dimension, ...]

    def predicate(self, selection: dict[str, list], skip: set[str] = frozenset()) -> Column:
        active = [d.predicate(selection[d.name]) for d in self.dimensions if selection.get(d.name) and d.name not in skip]
        return reduce(lambda a, b: a & b, active, F.lit(True))

    def options(self, df: DataFrame, selection: dict[str, list], day: Column) -> DataFrame:
        """facet, value, n, first_day: for each dimension, values under all *other* selections.

        One scan: each row carries (facet, value) pairs of every dimension whose other selections it meets.
        """
        pairs = [
            F.when(self.predicate(selection, {d.name}), F.transform(d.as_array(), _labelled(d.name))).otherwise(F.array())
            for d in self.dimensions
        ]
        long = df.select(day.alias("__day"), F.explode(F.flatten(F.array(*pairs))).alias("p")).where("p.value IS NOT NULL")
        return long.groupBy("p.facet", "p.value").agg(F.count("*").alias("n"), F.min("__day").alias("first_day"))

    def valid(self, df: DataFrame, selection: dict[str, list]) -> DataFrame:
        """facet, value of the chosen values that occur in the data at all; unknown ones are dropped."""
        spark = df.sparkSession
        chosen = spark.createDataFrame([(k, str(v)) for k, vs in selection.items() for v in vs], "facet string, value string")
        known = self.options(df, {}, F.lit(None).cast("date")).select("facet", "value")
        return chosen.join(known, ["facet", "value"], "left_semi")


def keep_tag(tags: Column, key: str) -> Column:
    return F.filter(tags, lambda t: t["key"] == key)


def scope_tags(tags: Column, field: str, value: str) -> Column:
    """Tags of one perspective; the row stays even if none are left."""
    return F.filter(tags, lambda t: t[field] == value)
