"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Sources (by code point, null last) weigh ``weights``, repeating.  Their targets share the total size
by weight; none may exceed ``max_epochs`` times its source, and what one cannot use is shared again
among the rest.  Each source is shuffled by a hash of the row, and its documents are queued ``max_epochs``
times over.  Every copy gets a virtual finish time: source words up to its end, divided by the source's
target.  A copy that runs over its source's target is queued as two parts, cut there.  Parts in the global
order of their finish times are taken until the total budget is spent.

The global order is a range sort: parts fall into ranges of the finish time, the running total over
ranges finds the one where the budget ends (:func:`end_of_mix`), and only that range is sorted.  What is
taken of a row then follows from its own finish times, without a join.

No window spans a source: a source's shuffled rows fall into buckets by the leading bits of the
hash, running sums are taken inside a bucket and over bucket totals, so a source that holds a third
of all rows is spread over as many tasks as it has buckets.  The hash is of id and text, so rows of one id,
or of none, spread like others unless they are equal.

Edge cases: null or empty text has size 0 and is taken with 0 words; a source of size 0 has target
0; a null source is a source of its own; equal rows are told apart by nothing, and any of them may
be the one that is cut; an empty table gives no rows; extra columns pass through ``mix`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Separators of words (fixed values).
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Targets are min(max_epochs * size, level * weight) with the level at which they sum to the
    total; sources in order of max_epochs * size / weight reach their bound first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every, below = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    )
    # The first source that stays below its bound fixes the level; all later ones do too.
    fixed = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("level", level)
        .withColumn("level", fixed)
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def mix_plan(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, rows_per_bucket: int = 4096, whole: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, position (source words before the document) per row.

    With ``whole`` also ``rest``, a struct of the row's columns.
    """
    rest = [F.struct(*[docs[c] for c in docs.columns]).alias("rest")] if whole else []
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))).alias("h"), *rest)
    n = max(1, docs.count() // rows_per_bucket)
    buckets = 1 << max(0, (n - 1).bit_length())
    prefix = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(F.coalesce(prefix, F.lit(0)) / F.lit((1 << 32) // buckets)).cast("int"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select(
        "source",
        "bucket",
        (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"),
    )
    targets = source_targets(totals.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    before = before.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(inside) - F.col("size"))
    return (
        rows.alias("r")
        .join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
        .select("r.doc_id", "r.size", "r.source", "b.source_size", "b.target", (F.col("b.base") + F.col("r.run")).alias("position"), *(["r.rest"] if whole else []))
    )


def copies_taken(max_epochs: int = 3) -> Column:
    """What :func:`mixed` must take of each copy, in closed form: source words up to the floored target."""
    left = lambda e: F.floor("target") - F.col("position") - F.col("source_size") * e
    return F.array(*[F.greatest(F.lit(0), F.least(F.col("size"), left(e))).cast("long") for e in range(max_epochs)])


def parts(max_epochs: int = 3) -> Column:
    """The queued parts of a row, in order: an array of (words, finish), two for each copy.

    The second part of a copy is what lies beyond its source's (floored) target; it is empty but for one copy.
    """
    out = []
    for e in range(max_epochs):
        start = F.col("position") + F.col("source_size") * e
        first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
        for words, end in ((first, start + first), (F.col("size") - first, start + F.col("size"))):
            finish = F.coalesce(F.try_divide(end, F.col("target")), F.lit(0.0))
            out.append(F.struct(words.cast("long").alias("words"), finish.alias("finish")))
    return F.array(*out)


def end_of_mix(plan: DataFrame, max_epochs: int = 3, ranges: int = 1 << 12) -> DataFrame:
    """One row ``last``: the finish time of the last part within the total budget (null without rows).

    ``ranges`` divide the virtual time of one unit; sources are served evenly, so they hold like numbers of parts.
    """
    queued = plan.select(F.explode(parts(max_epochs)).alias("p")).select("p.words", "p.finish").where("words > 0")
    queued = queued.withColumn("range", F.floor(F.least(F.col("finish"), F.lit(4.0)) * ranges).cast("int"))
    totals = queued.groupBy("range").agg(F.sum("words").alias("n"))
    budget = plan.select("source", F.floor("target").alias("t")).distinct().agg(F.sum("t").alias("budget"))
    run = totals.select("range", "n", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    # Ranges wholly within the budget end at their last part; the one where it ends is sorted.
    cut = run.join(F.broadcast(budget)).where(F.col("before") < F.col("budget")).agg(F.max_by(F.struct("range", "before", "budget"), "range").alias("c")).select("c.*")
    near = queued.join(F.broadcast(cut), "range")
    inside = Window.partitionBy("range").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    fit = near.withColumn("sum", F.sum("words").over(inside)).where(F.col("before") + F.col("sum") <= F.col("budget"))
    # With no part of the range within the budget, all of the ranges before it are.
    low = cut.select((F.col("range") / F.lit(float(ranges))).alias("low"))
    return fit.agg(F.max("finish").alias("fit")).join(F.broadcast(low)).select(F.coalesce("fit", "low").alias("last"))


def mixed(plan: DataFrame, max_epochs: int = 3, narrow: DataFrame | None = None) -> DataFrame:
    """``plan`` with ``copies``: the words taken of each copy of the row, in an array.

    ``narrow`` is the same plan without texts, from which the end of the mix is found.
    """
    last = end_of_mix(plan if narrow is None else narrow, max_epochs)
    # Parts 2 e and 2 e + 1 belong to copy e.
    words = lambda i: F.when(F.col("p")[i]["finish"] <= F.col("last"), F.col("p")[i]["words"]).otherwise(F.lit(0).cast("long"))
    copies = F.array(*[words(2 * e) + words(2 * e + 1) for e in range(max_epochs)])
    return plan.join(F.broadcast(last)).withColumn("p", parts(max_epochs)).withColumn("copies", copies).drop("p", "last")


def mix_totals(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    plan = scratch(mix_plan(docs, weights, max_epochs), "mix-plan")
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, x: s + x)
    return mixed(plan, max_epochs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mix itself: a row per copy with all columns of ``docs``, in order of virtual finish time.

    The text of a straddling copy ends after its last taken word; ``n_chars``, where there, follows.
    The columns travel with the plan, so rows of one doc_id, or of none, are taken each by itself.
    """
    cols = docs.columns
    narrow = scratch(mix_plan(docs, weights, max_epochs).select("source", "size", "source_size", "target", "position"), "mix-plan")
    plan = mixed(mix_plan(docs, weights, max_epochs, whole=True), max_epochs, narrow).select(
        "rest", F.col("size").alias("__size"), "position", "source_size", "target",
        F.posexplode("copies").alias("__epoch", "__taken"),
    )
    copies = plan.where((F.col("__taken") > 0) | ((F.col("__size") == 0) & (F.col("__epoch") == 0))).withColumn(
        "__finish", F.coalesce(F.try_divide(F.col("position") + F.col("source_size") * F.col("__epoch") + F.col("__taken"), F.col("target")), F.lit(0.0))
    )
    out = copies.select(*[F.col("rest")[c].alias(c) for c in cols], "__size", "__taken", "__finish")
    # The rest after the last taken word: what a split at word ends leaves unsplit.
    rest = F.element_at(F.split("text", r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]+", (F.col("__taken") + 1).cast("int")), -1)
    keep = F.regexp_replace(F.expr("left(text, length(text) - length(__rest))"), r"[\x20\x09-\x0D]+$", "")
    text = F.when(F.col("__taken") < F.col("__size"), keep).otherwise(F.col("text"))
    out = out.withColumn("__rest", F.when(F.col("__taken") < F.col("__size"), rest)).withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("__taken") < F.col("__size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.orderBy("__finish", "doc_id").select(*cols)


#: The same in SQL: the shuffle is the order of an MD5 of id and text, so any engine can repeat it.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(text))) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
l AS (
  SELECT *, source_size * 3 AS cap,
    CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight) AS target FROM l),
p AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.size, t.source_size, t.target,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS position
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT r, size, target, position + e * source_size AS start,
    CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - position - e * source_size)) AS BIGINT) AS first
  FROM p, (VALUES (0), (1), (2)) AS v(e)),
q AS (
  SELECT r, first AS words, (start + first) / target AS finish FROM c WHERE first > 0
  UNION ALL SELECT r, size - first, (start + size) / target FROM c WHERE size > first),
o AS (SELECT r, words, CAST(sum(words) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM q),
k AS (SELECT r, CAST(sum(words) AS BIGINT) AS taken FROM o WHERE spent <= (SELECT sum(floor(target)) FROM t) GROUP BY r)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0) AS taken
FROM p LEFT JOIN k ON p.r = k.r
"""
