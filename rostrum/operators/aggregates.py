"""Statistics and rankings over arguments, turns and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import pct, prf, ratio
from ..functions.text import flesch_douma, lix

STANCES = {"F": "pro", "O": "contra", "P": "unclear"}


def stance_counts(df: DataFrame, stance: str, by: list[str], names: dict[str, str] = STANCES) -> DataFrame:
    """Per group: total, one count and one percentage per stance."""
    counts = [F.count(F.when(F.col(stance) == k, 1)).alias(v) for k, v in names.items()]
    out = df.groupBy(*by).agg(F.count("*").alias("total"), *counts)
    return out.select(*by, "total", *names.values(), *[pct(F.col(v), F.col("total")).alias(f"{v}_pct") for v in names.values()])


def typology_matrix(df: DataFrame, typology: str, stance: str, domain: list[str], names: dict[str, str] = STANCES) -> DataFrame:
    """Counts by typology and stance; every typology of the domain has a row."""
    dom = df.sparkSession.createDataFrame([(d,) for d in domain], f"{typology} string")
    got = df.groupBy(typology).agg(F.count("*").alias("total"), *[F.count(F.when(F.col(stance) == k, 1)).alias(v) for k, v in names.items()])
    cols = ["total", *names.values()]
    return dom.join(got, typology, "left").select(typology, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])


#: Verbosity measures as ratios of sums: name -> (numerator, denominator).
RATIOS = {
    "chars_per_turn": ("chars", "turns"),
    "words_per_sentence": ("words", "sentences"),
    "unique_share": ("unique_words", "words"),
    "args_per_1000_chars": ("args_1000", "chars"),
    "claims_per_arg": ("claims", "args"),
    "chars_per_quote": ("quote_chars", "args"),
}


def verbosity(df: DataFrame) -> DataFrame:
    """Measures from per-group sums (turns, chars, words, sentences, syllables, long_words, ...), zero-guarded."""
    df = df.withColumn("args_1000", F.col("args") * 1000)
    n, s = F.col("words"), F.col("sentences")
    more = [flesch_douma(n, s, F.col("syllables")).alias("flesch_douma"), lix(n, s, F.col("long_words")).alias("lix")]
    return df.select(*[c for c in df.columns if c != "args_1000"], *[ratio(F.col(a), F.col(b)).alias(k) for k, (a, b) in RATIOS.items()], *more)


def median(x: Column) -> Column:
    """Mean of the middle two; 0 for no values."""
    return F.coalesce(F.median(x), F.lit(0.0))


def rates_with_zeros(entity_tags: DataFrame, totals: DataFrame, entity: str, tag: str) -> DataFrame:
    """entity, tag, rate for every entity and tag; an entity that never uses a tag has rate 0.

    Missing pairs are not made: the median over all entities follows from the rates that exist and
    the number of entities, see ``median_rates``.
    """
    n = entity_tags.groupBy(entity, tag).agg(F.count("*").alias("n"))
    return n.join(totals, entity).select(entity, tag, (F.col("n") / F.col("total")).alias("rate"))


def median_rates(rates: DataFrame, entities: int, tag: str) -> DataFrame:
    """Median rate per tag over ``entities`` entities, absent pairs counting 0, without expanding them."""
    w = Window.partitionBy(tag).orderBy("rate")
    zeros = F.lit(entities) - F.count("*").over(Window.partitionBy(tag))
    ranked = rates.withColumn("pos", F.row_number().over(w) + zeros).withColumn("zeros", zeros)
    lo, hi = (entities + 1) // 2, entities // 2 + 1
    mid = ranked.groupBy(tag).agg(F.coalesce(F.max(F.when(F.col("pos") == lo, F.col("rate"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(F.col("pos") == hi, F.col("rate"))), F.lit(0.0)).alias("b"))
    return mid.select(tag, ((F.col("a") + F.col("b")) / 2).alias("median_rate"))


def lift(counts: DataFrame, entity: str, tag: str, n: str) -> DataFrame:
    """Over-representation: share of a tag within an entity over its share overall."""
    out = counts.join(counts.groupBy(entity).agg(F.sum(n).alias("entity_total")), entity)
    out = out.join(counts.groupBy(tag).agg(F.sum(n).alias("tag_total")), tag)
    out = out.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("all_total"))))  # one row
    share = F.col(n) / F.col("entity_total")
    return out.withColumn("share", share).withColumn("lift", share / (F.col("tag_total") / F.col("all_total")))


def dominant(pro: Column, contra: Column, unclear: Column) -> Column:
    """The most frequent stance; ties go to pro, then contra."""
    return F.when((pro >= contra) & (pro >= unclear), "pro").when(contra >= unclear, "contra").otherwise("unclear")


def micro_prf(df: DataFrame, by: list[str], tp: str, fp: str, fn: str) -> DataFrame:
    """Summed outcomes and micro-averaged precision, recall and F1."""
    s = df.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in (tp, fp, fn)])
    p, r, f = prf(F.col(tp), F.col(fp), F.col(fn))
    return s.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings: one row."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    plogp = lambda c, n: F.sum(c * F.ln(c))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("pa"), plogp(F.col("n"), None).alias("ha"), F.sum("n").alias("n"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("pb"), plogp(F.col("n"), None).alias("hb"))
    both = cells.agg(pairs(F.col("n")).alias("pab"), plogp(F.col("n"), None).alias("hab"))
    one = rows.crossJoin(cols).crossJoin(both)  # one row each
    n = F.col("n")
    expected = F.try_divide(F.col("pa") * F.col("pb"), n * (n - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("pab") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0))
    ha, hb = F.ln(n) - F.col("ha") / n, F.ln(n) - F.col("hb") / n
    mi = ha + hb - (F.ln(n) - F.col("hab") / n)
    return one.select(ari.alias("ari"), F.coalesce(F.try_divide(mi, (ha + hb) / 2), F.lit(1.0)).alias("nmi"), F.col("n").cast("long").alias("n"))
