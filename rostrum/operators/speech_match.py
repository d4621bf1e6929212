"""Quoted parts matched to the speech that holds them, and evaluation records built on the matches.

A quote names its speaker, perhaps the day, and the year.  Its candidates are the speaker's speeches of that day; only where there is none at
all, those of the year.  Containment is looked up in a sparse index of the speeches' grams: of a quote's longest part the stretch whose grams
are rarest among the candidates is asked for, and only speeches that hold one of those grams are read.

Edge cases: an empty part is in every speech and a null part in none; a quote without parts is in none; null speakers match nothing; a null
day goes by the year; equal speeches are separate candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .intervals import drop_nested

#: Classes of parts by length: (least length, gram, step), least = gram + step - 1; shorter ones are compared with all speeches of their key.
CLASSES = ((19, 12, 8), (11, 8, 4), (6, 4, 3))
#: The speeches of a key are dealt out to so many tasks for that.
DEALS = 8


def containing(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote, candidates, speech: number and least of the speeches (key, speech, text) of a quote's key that hold all its parts, if any.

    ``quotes``: key, quote, parts.  Equal quotes of a key are one question.  Grams are known by a hash together with their key, and only
    those that are asked for stay; every candidate is compared in full.  Files of grams are small and long in memory: no side is broadcast.
    """
    longest = F.aggregate("parts", F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    sound = quotes.where(F.coalesce((F.size("parts") > 0) & F.forall("parts", lambda p: p.isNotNull()), F.lit(False)))
    sound = sound.select(F.col("key").cast(texts.schema["key"].dataType).alias("key"), "quote", "parts")
    # Quotes may share a number, so a question has one of its own.
    sound = sound.withColumn("question", F.xxhash64("key", "parts"))
    asked = scratch(sound.select("key", "parts", "question").distinct().withColumn("needle", longest), "speech-questions")

    def hashed(text, places, gram: int):
        # Not an argument of the lambda: Spark would give it the index of the place.
        return F.transform(places, lambda p: F.xxhash64("key", F.substr(text, p, F.lit(gram))))

    n, size = F.length("needle"), F.length("text")
    stretches, grams, upper = None, [], None
    for least, gram, step in CLASSES:
        mine = asked.where((n >= least) & (n < upper) if upper else n >= least)
        upper = least
        # Stretches of ``step`` neighbouring grams: whatever the place of the part, one of them is indexed.
        s = mine.select("key", "question", "needle", F.explode(F.sequence(F.lit(1), n - gram - step + 2, F.lit(step))).alias("s"))
        s = s.select("question", "s", F.explode(F.array_distinct(hashed(F.col("needle"), F.sequence(F.col("s"), F.col("s") + (step - 1)), gram))).alias("h"))
        stretches = s if stretches is None else stretches.unionByName(s)
        places = F.when(size >= gram, F.sequence(F.lit(1), size - gram + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        grams.append(hashed(F.col("text"), places, gram))
    index = texts.select("speech", F.explode(F.array_distinct(F.concat(*grams))).alias("h"))
    held = scratch(index.join(stretches.select("h").distinct().hint("merge"), "h", "left_semi"), "grams")
    counts = held.groupBy("h").agg(F.count("*").alias("n"))
    weighed = stretches.join(counts.hint("merge"), "h", "left").repartition("question")
    weighed = weighed.withColumn("cost", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("question", "s")))
    rarest = weighed.withColumn("r", F.dense_rank().over(Window.partitionBy("question").orderBy("cost", "s"))).where("r = 1 AND n > 0").select("question", "h")
    got = held.join(rarest.hint("merge"), "h").select("question", "speech").distinct()
    parts = asked.select("key", "question", "parts")
    long = texts.join(got.join(parts.hint("merge"), "question").hint("merge"), ["key", "speech"])
    few = asked.where(n < upper).select(*parts.columns).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    short = texts.withColumn("deal", F.pmod(F.xxhash64("speech"), F.lit(DEALS)).cast("int")).join(few.hint("merge"), ["key", "deal"])
    holds = F.forall("parts", lambda p: F.contains("text", p))
    hits = long.where(holds).select("question", "speech").unionByName(short.where(holds).select("question", "speech"))
    best = hits.groupBy("question").agg(F.count("*").alias("candidates"), F.min("speech").alias("speech"))
    return sound.select("quote", "question").join(best.hint("merge"), "question").select("quote", "candidates", "speech")


def match(speeches: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote, outcome (unique, ambiguous, not_found), candidates and speech (the first that matches) of every quote.

    ``speeches``: speech, speaker, day, year, text; ``quotes``: quote, speaker, day, year, parts (array of texts).
    """
    day, year = F.struct("speaker", "day"), F.struct("speaker", "year")
    whole = lambda key: F.col("speaker").isNotNull() & F.col(key).isNotNull()
    q = scratch(quotes.select("quote", "speaker", "day", "year", "parts"), "speech-quotes")
    known = speeches.where(whole("day")).select(day.alias("key"), F.lit(True).alias("known")).distinct()
    q = scratch(q.withColumn("key", F.when(whole("day"), day)).join(known.hint("merge"), "key", "left"), "speech-days")
    by_day = q.where("known").select("key", "quote", "parts")
    rest = q.where(F.col("known").isNull() & whole("year")).select(year.alias("key"), "quote", "parts")
    best = containing(speeches.where(whole("day")).select(day.alias("key"), "speech", "text"), by_day).unionByName(
        containing(speeches.where(whole("year")).select(year.alias("key"), "speech", "text"), rest)
    )
    # Quotes of one number are one quote.
    best = best.groupBy("quote").agg(F.sum("candidates").alias("candidates"), F.min("speech").alias("speech"))
    n = F.coalesce("candidates", F.lit(0))
    outcome = F.when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous")
    return q.select("quote").join(best.hint("merge"), "quote", "left").select("quote", outcome.alias("outcome"), n.alias("candidates"), "speech")


def _span(part: str):
    """Characters from 0 of a part's first place in the text."""
    at = F.expr(f"locate({part}, text)") - 1
    return at, at + F.length(part)


def records(speeches: DataFrame, relations: DataFrame, fallacies: DataFrame) -> DataFrame:
    """speech, spans, fallacies: for every speech with any, sorted arrays of (start, end) and (start, end, label).

    ``relations``: quote, speaker, other (the second speaker), kind, target, day, year, dependent, governor: supports of claims by the same
    speaker count; all premises of one claim in a speech are one span from the first to the last of their characters.  ``fallacies``: quote,
    speaker, day, year, text, label; a span inside another of its label is dropped.
    """
    use = relations.where((F.col("kind") == "Support") & (F.col("target") == "Claim") & (F.col("speaker") == F.col("other")))
    text = speeches.select("speech", "text")
    named = fallacies.withColumnRenamed("text", "part")
    # Both kinds of quotes are looked up together.
    ask = lambda df, kind, *parts: df.select(F.struct(F.lit(kind).alias("kind"), "quote").alias("quote"), "speaker", "day", "year", F.array(*parts).alias("parts"))
    every = match(speeches, ask(use, "relation", "dependent", "governor").unionByName(ask(named, "fallacy", "part")))
    every = scratch(every.where("speech IS NOT NULL").select("quote", "speech"), "speech-matches")
    answers = lambda kind: every.where(F.col("quote.kind") == kind).select("quote.quote", "speech")
    placed = use.select("quote", "dependent", "governor").join(answers("relation"), "quote").join(text, "speech")
    (a, b), (c, d) = _span("dependent"), _span("governor")
    spans = placed.groupBy("speech", "governor").agg(F.min(F.least(a, c)).alias("start"), F.max(F.greatest(b, d)).alias("end"))
    spans = spans.groupBy("speech").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    s, e = _span("part")
    f = named.select("quote", "part", "label").join(answers("fallacy"), "quote").join(text, "speech").select("speech", "label", s.alias("start"), e.alias("end")).distinct()
    f = drop_nested(f.withColumn("id", F.lit(0)), ["speech", "label"]).groupBy("speech").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("fallacies"))
    both = spans.join(f, "speech", "full")
    return both.select("speech", *[F.coalesce(c_, F.expr("array()").cast(dict(both.dtypes)[c_])).alias(c_) for c_ in ("spans", "fallacies")])
