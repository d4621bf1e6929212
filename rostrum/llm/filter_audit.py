"""Audit of how text filters interact, by direct relational replay. DataFrame functions only.

Every document gets one flag per filter.  Each document's flags meet all orders of the filters, a broadcast
of n! rows (120 for five), every order is exploded into its steps, the step at which the document first fails is
the least place of a failing filter in that order, and conditional counts by part, order and step are added up.
The replayed rows are never written or shuffled: tasks combine them into one row per part, order and step before the
exchange, so a part with a third of all documents is one partial row per task.

Filter E marks texts that a smaller doc_id has too.  Texts are compared by SHA-256; groups are pre-aggregated in
each task, and looked up again through :func:`join_spread`, so a text or id that a third of all rows share does not go to
one task.

Edge cases: a null text is empty (it fails A, and copies of it fail E); a null source is part ``""``, together with the
empty source; a null doc_id has no smaller one, is none and has no label; rows that share the smallest doc_id of their
text all pass E; repeated labels count as 1 if any of them is 1; a null label counts as 0; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Separators of words, characters of filter D (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
LETTERS = "ABCDE"
#: Keys with more than one row in so many are broadcast; there are fewer of them than this.
SHARE = 1000


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, counted: DataFrame, total: int, share: int | None = None) -> DataFrame:
    """Left join with a lookup of one row a key, safe where few keys hold most of ``rows``.

    ``counted`` has the keys of ``rows``, ``total`` of them.  Keys of more than ``total / share`` rows, fewer than ``share`` in number, are looked up in a broadcast; rows of all
    others, and of null keys, move no key's worth of more than that.
    """
    share = share or SHARE
    heavy = counted.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * share > total).select(key, F.lit(True).alias("heavy_"))
    few = heavy.join(lookup, key, "left")
    marked = rows.join(F.broadcast(few), key, "left")
    own = [c for c in lookup.columns if c != key]
    hot = marked.where(F.col("heavy_") | F.col(key).isNull()).select(*rows.columns, *own)
    rest = marked.where(F.col("heavy_").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return hot.unionByName(rest.join(lookup, key, "left").select(*rows.columns, *own))


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, and a bit for each of the filters A to D that the text fails."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.select("*", words.alias("words")).select(
        "doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different")
    )
    fails = [
        F.col("n") < 50,
        F.col("different").cast("long") * 100 < F.col("n").cast("long") * 65,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
        text.rlike(SYMBOLS),
    ]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), "part", F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits"))


def flag_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (of all five filters), good and toxic of every document."""
    flags = scratch(text_flags(docs), "filter-flags")
    total = flags.count()
    repeated = (
        flags.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows_")).where("rows_ > 1").select("digest", "first_doc")
    )
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic_"))]
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(*marks).where("good OR toxic_")
    copies = join_spread(flags, repeated, "digest", flags, total)
    later = F.when(F.col("first_doc") < F.col("doc_id"), 1 << LETTERS.index("E")).otherwise(0)
    every = copies.select("doc_id", "part", (F.col("bits") + later).alias("bits"))
    found = join_spread(every, labelled, "doc_id", flags, total)
    return found.select("part", "bits", *[F.coalesce(c, F.lit(False)).alias(c.strip("_")) for c in ("good", "toxic_")])


def replay(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, from one row of ``bits`` (bit i: fails filter i) per document."""
    spark = flags.sparkSession
    orders = ["".join(p) for p in permutations(letters)]
    steps = [F.struct((F.lit(k + 1)).alias("step"), F.substring("filter_order", k + 1, 1).alias("filter")) for k in range(len(letters))]
    orders_df = spark.range(1).select(F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    orders_df = orders_df.select("filter_order", *[F.instr("filter_order", x).alias(f"at_{x}") for x in letters], F.array(*steps).alias("steps"))

    def fails(i: int) -> Column:
        return F.col("bits").bitwiseAND(1 << i) != 0

    never = len(letters) + 1
    first = F.least(*[F.when(fails(i), F.col(f"at_{x}")).otherwise(never) for i, x in enumerate(letters)])
    mask = F.element_at(F.create_map(*[F.lit(v) for i, x in enumerate(letters) for v in (x, 1 << i)]), F.col("s.filter"))
    rows = (
        flags.crossJoin(F.broadcast(orders_df))
        .select("part", "filter_order", "bits", "good", "toxic", first.alias("first"), F.explode("steps").alias("s"))
        .select("part", "filter_order", "s.step", "s.filter", "bits", "good", "toxic", "first", mask.alias("mask"))
    )
    removed = F.col("first") == F.col("step")
    counts = rows.groupBy("part", "filter_order", "step", "filter").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((F.col("bits").bitwiseAND(F.col("mask")) != 0) & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("bits") == F.col("mask")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # The rows of a filter in a part are n! counts, whatever the number of documents.
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return counts.withColumn("shapley", shapley).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replay(flag_documents(docs, labels))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM texts
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         list_value(len(w) < 50, 100 * list_unique(w) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
                    regexp_matches(text, '[#$%&*|]'), coalesce(first_doc < words.doc_id, false)) AS f
  FROM words LEFT JOIN marks USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), replayed AS (
  SELECT part, good, toxic, filter_order, f,
         list_position([f[ascii(filter_order[k]) - 64] FOR k IN [1, 2, 3, 4, 5]], true) AS first
  FROM flags, orders
), steps AS (
  SELECT *, coalesce(first, 6) AS first_fail, unnest([1, 2, 3, 4, 5]) AS step FROM replayed
), counts AS (
  SELECT part, filter_order, step, filter_order[step] AS x,
         count(*) FILTER (first_fail > step) AS kept, count(*) FILTER (first_fail = step) AS removed,
         count(*) FILTER (f[ascii(filter_order[step]) - 64] AND first_fail < step) AS redundant,
         count(*) FILTER (f[ascii(filter_order[step]) - 64] AND list_sum([CAST(y AS INT) FOR y IN f]) = 1) AS unique_fails,
         count(*) FILTER (first_fail = step AND good = 1) AS good_lost, count(*) FILTER (first_fail = step AND toxic = 1) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counts
"""
