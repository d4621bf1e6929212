"""Quotes found in subtitles, and the shift between the subtitles' clock and the video's.

Subtitles are cues (debate, seq, start, end, text); their normalised texts joined by one space are the debate's running
text, which is never put together.  ``find_spans`` looks quotes up in a sparse position index: the running text's grams at
every ``step``-th place, and a quote's grams at its first ``step`` places, so a quote meets only the places where one of its grams
stands.  Each place is verified cue by cue against the whole quote.

``calibrate`` gives every quote its span on the video's clock.  A turn with an anchor (a speaker event near the time it is
expected) is shifted by itself: its opening words stand at the anchor, or else its first quote found does; without any quote found its
quotes last as long as speaking them takes.  All other turns share one shift a debate, the median over turns of the least difference
between a quote's place and the turn's expected time, if there are enough turns and they agree.

Edge cases: a quote without letters and digits, or one that does not occur, has no span (but see anchored turns); of several
places the first counts; cues without text only part their neighbours by two spaces; null times of a turn give it no anchor and no sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, speaking_seconds
from ..session import scratch
from . import intervals

#: Classes of quotes by length: (least length, gram, step); a quote of at least gram + step - 1 characters holds an indexed gram.
CLASSES = ((23, 16, 8), (7, 4, 4), (4, 3, 2), (1, 1, 1))


def running_cues(cues: DataFrame) -> DataFrame:
    """Cues with their normalised text ``t`` and the place of its first character in the running text.

    A cue owns its characters and the space behind them.
    """
    own = cues.select("debate", "seq", "start", "end", normalize(F.coalesce("text", F.lit(""))).alias("t"))
    return intervals.running_offsets(own, "debate", "seq", F.col("t")).withColumnRenamed("start_offset", "at").drop("end_offset")


def position_index(running: DataFrame, gram: int, step: int) -> DataFrame:
    """key, at: the grams of the running text at every ``step``-th place, as hashes with their debate."""
    # Each following cue adds at least its space, so as many cues as a gram has characters complete the last grams.
    ahead = Window.partitionBy("debate").orderBy("seq").rowsBetween(1, gram)
    text = F.concat_ws(" ", F.col("t"), F.array_join(F.collect_list("t").over(ahead), " "))
    rows = running.select("debate", "at", F.length("t").alias("n"), text.alias("text"))
    first = F.pmod(-F.col("at"), F.lit(step).cast("long"))
    places = F.when(first <= F.col("n"), F.sequence(first, F.col("n").cast("long"), F.lit(step).cast("long")))
    one = rows.select("debate", "at", "text", F.explode(places).alias("p"))
    gram_ = F.substr("text", (F.col("p") + 1).cast("int"), F.lit(gram))
    return one.where(F.length(gram_) == gram).select(F.xxhash64("debate", gram_).alias("key"), (F.col("at") + F.col("p")).alias("at"))


def candidates(running: DataFrame, needles: DataFrame) -> DataFrame:
    """debate, id, needle, at: places where a needle could stand (hashes of grams may agree by chance, and places may come twice)."""
    out = None
    upper = None
    for least, gram, step in CLASSES:
        n = F.length("needle")
        mine = needles.where((n >= least) & (n < upper) if upper else n >= least)
        offs = F.explode(F.sequence(F.lit(0), F.lit(step - 1)))
        asked = mine.select("debate", "id", "needle", offs.alias("o"))
        # The needle itself is added once its places are known; it would go along with each of its grams.
        asked = asked.select("debate", "id", "o", F.xxhash64("debate", F.substr("needle", F.col("o") + 1, F.lit(gram))).alias("key"))
        # Short quotes need a place for every character: only debates that have any are indexed for them.
        place = running if upper is None else running.join(mine.select("debate").distinct(), "debate", "left_semi")
        hit = asked.join(position_index(place, gram, step), "key")
        hit = hit.select("debate", "id", (F.col("at") - F.col("o")).alias("at")).where("at >= 0")
        out = hit if out is None else out.unionByName(hit)
        upper = least
    return out.join(needles, ["debate", "id"])


def find_spans(running: DataFrame, quotes: DataFrame, width: int = 512) -> DataFrame:
    """debate, id, at, raw_start, raw_end: first place of each quote (debate, id, quote) and the times of its first and last cue."""
    needles = quotes.select("debate", "id", normalize(F.col("quote")).alias("needle")).where("needle <> ''")
    cand = candidates(running, needles).withColumn("stop", F.col("at") + F.length("needle"))
    block = lambda c: F.floor(c / width)
    asked = cand.withColumn("b", F.explode(F.sequence(block(F.col("at")), block(F.col("stop") - 1))))
    cue_stop = F.col("cue_at") + F.length("t") + 1
    cues = running.withColumnRenamed("at", "cue_at").withColumn("cue_stop", cue_stop)
    cues = cues.withColumn("b", F.explode(F.sequence(block(F.col("cue_at")), block(F.col("cue_stop") - 1))))
    lo, hi = F.greatest("at", "cue_at"), F.least("stop", "cue_stop")
    # A pair that shares several blocks counts in the first.
    met = asked.join(cues, ["debate", "b"]).where((lo < hi) & (F.col("b") == block(lo)))
    piece = lambda text, base: F.substr(text, (lo - F.col(base) + 1).cast("int"), (hi - lo).cast("int"))
    same = piece(F.col("needle"), "at") == piece(F.concat("t", F.lit(" ")), "cue_at")
    whole = met.groupBy("debate", "id", "at", "stop").agg(
        F.min(same).alias("same"), F.sum(hi - lo).alias("n"), F.min_by("start", "seq").alias("raw_start"), F.max_by("end", "seq").alias("raw_end")
    )
    found = whole.where(F.col("same") & (F.col("n") == F.col("stop") - F.col("at")))
    best = found.groupBy("debate", "id").agg(F.min(F.struct("at", "raw_start", "raw_end")).alias("m"))
    return best.select("debate", "id", "m.at", "m.raw_start", "m.raw_end")


def debate_shifts(found: DataFrame, least: int = 3, spread: float = 800.0) -> DataFrame:
    """debate, shift from quotes found (debate, raw_start, expected): the median of the least difference per turn.

    Quotes of one expected time belong to one turn; the one nearest its beginning counts.  Debates with fewer than ``least``
    turns, or whose turns differ by over ``spread`` seconds, have no shift.
    """
    turn = found.where("expected IS NOT NULL").groupBy("debate", "expected").agg(F.min(F.col("raw_start") - F.col("expected")).alias("d"))
    debate = turn.groupBy("debate").agg(F.count("*").alias("turns"), (F.max("d") - F.min("d")).alias("spread"), F.median("d").alias("shift"))
    return debate.where((F.col("turns") >= least) & (F.col("spread") <= spread)).select("debate", "shift")


def anchors(turns: DataFrame, events: DataFrame, window: float = 180.0) -> DataFrame:
    """debate, turn, anchor: the nearest event of the turn's person and type within ``window`` seconds of its expected time.

    ``turns``: debate, turn, person, kind, expected; ``events``: debate, event, person, kind, at (null persons, kinds and times match nothing).
    """
    asked = turns.where("expected IS NOT NULL").withColumn("key", F.struct("debate", "turn"))
    near = intervals.nearest(asked, events.where("at IS NOT NULL"), ["debate", "person", "kind"], "expected", "at", "key", "event", window)
    place = events.select(F.col("debate").alias("d"), F.col("event").alias("nearest_id"), F.col("at").alias("anchor"))
    return near.withColumn("d", F.col("key.debate")).join(place, ["d", "nearest_id"]).select("key.debate", "key.turn", "anchor")


def opening(text: Column, words: int = 10, least: int = 4) -> Column:
    """The first words of a turn behind its speaker's label; null if there are too few to be found."""
    own = F.filter(F.split(F.trim(F.regexp_replace(text, r"^[^:\n]{1,80}:\s*", "")), r"\s+"), lambda w: w != "")
    return F.when(F.size(own) >= least, F.array_join(F.slice(own, 1, words), " "))


def calibrate(cues: DataFrame, quotes: DataFrame, turns: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """debate, id, start, end, tier of all quotes that get a span: ``opening``, ``first_quote``, ``estimate`` (anchored turns) or ``debate``.

    ``quotes``: debate, turn, id, quote; ``turns``: debate, turn, expected and, for anchors, person, kind and text.
    """
    running = scratch(running_cues(cues), "running-cues")
    found = scratch(find_spans(running, quotes).join(quotes.select("debate", "turn", "id"), ["debate", "id"]), "quote-spans")
    times = turns.select("debate", "turn", "expected")
    if events is None:
        free = found.join(times, ["debate", "turn"])
    else:
        held = scratch(anchors(turns, events), "anchors")
        heads = turns.join(held, ["debate", "turn"]).select("debate", F.col("turn").alias("id"), opening(F.col("text")).alias("quote"))
        heads = find_spans(running, heads).select("debate", F.col("id").alias("turn"), F.col("raw_start").alias("head"))
        first = found.groupBy("debate", "turn").agg(F.min("raw_start").alias("first"))
        shift = held.join(first, ["debate", "turn"], "left").join(heads, ["debate", "turn"], "left")
        shift = shift.select("debate", "turn", "anchor", "first", "head")
        own = quotes.join(shift, ["debate", "turn"]).join(found.select("debate", "id", "raw_start", "raw_end"), ["debate", "id"], "left")
        by = F.coalesce("head", "first") - F.col("anchor")
        none = F.col("first").isNull()
        tier = F.when(none, "estimate").when(F.col("head").isNotNull(), "opening").otherwise("first_quote")
        start = F.when(none, F.col("anchor")).otherwise(F.col("raw_start") - by)
        end = F.when(none, F.col("anchor") + speaking_seconds(F.col("quote"))).otherwise(F.col("raw_end") - by)
        anchored = own.where(none | F.col("raw_start").isNotNull()).select("debate", "id", start.alias("start"), end.alias("end"), tier.alias("tier"))
        free = found.join(times, ["debate", "turn"]).join(held, ["debate", "turn"], "left_anti")
    moved = free.join(debate_shifts(free), "debate")
    shared = moved.select("debate", "id", (F.col("raw_start") - F.col("shift")).alias("start"), (F.col("raw_end") - F.col("shift")).alias("end"), F.lit("debate").alias("tier"))
    return shared if events is None else anchored.unionByName(shared)


def fragment_spans(cues: DataFrame, arguments: DataFrame, fragments: DataFrame) -> DataFrame:
    """debate, tag, start, end of fragments (debate, id, tag, fragment) inside the span of their argument (debate, id, quote, start).

    Only cues that touch the argument's own place are read.  Parts between ellipses are looked for one behind the other.
    """
    running = scratch(running_cues(cues), "running-cues")
    own = find_spans(running, arguments).join(arguments.select("debate", "id", F.col("start").alias("known")), ["debate", "id"])
    own = own.select("debate", "id", "raw_start", "raw_end", (F.col("raw_start") - F.col("known")).alias("shift"))
    span = lambda df, a, b: df.select("debate", F.col("key").alias("id"), F.col(a).alias("start"), F.col(b).alias("end"))
    pairs = intervals.overlaps(span(own.withColumn("key", F.col("id")), "raw_start", "raw_end"), span(running.withColumn("key", F.col("seq")), "start", "end"), "debate", 60.0, closed=True)
    near = pairs.select("debate", F.col("a_id").alias("id"), F.col("b_id").alias("seq")).join(running.select("debate", "seq", "start", "end", "t"), ["debate", "seq"])
    window = near.groupBy("debate", "id").agg(F.sort_array(F.collect_list(F.struct("seq", "t", "start", "end"))).alias("cues"))
    parts = F.filter(F.transform(F.split("fragment", r"\.\.\.|…"), normalize), lambda p: p != "")
    rows = fragments.join(window, ["debate", "id"]).select("debate", "id", "tag", "cues", parts.alias("parts")).where(F.size("parts") > 0)
    rows = rows.withColumn("text", F.array_join(F.transform("cues", lambda c: c["t"]), " "))
    start = F.struct(F.lit(0).alias("first"), F.lit(1).alias("next"))

    def step(s: Column, p: Column) -> Column:
        # Places count from 1; next = 0 says that a part is missing.
        rest = F.substr(F.col("text"), s["next"])
        at = F.when(s["next"] > 0, F.instr(rest, p)).otherwise(0)
        here = s["next"] + at - 1
        return F.struct(F.when(s["first"] == 0, here).otherwise(s["first"]).alias("first"), F.when(at > 0, here + F.length(p)).otherwise(0).alias("next"))

    hit = rows.withColumn("m", F.aggregate("parts", start, step)).where("m.next > 0")
    # Characters up to the end of each cue, its space included, tell which cue owns a place.
    ends = F.aggregate("cues", F.array().cast("array<int>"), lambda s, c: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.length(c["t"]) + 1)))
    hit = hit.withColumn("ends", ends)
    owner = lambda place: F.size(F.filter("ends", lambda e: e < place))
    raw_start, raw_end = F.get("cues", owner(F.col("m.first")))["start"], F.get("cues", owner(F.col("m.next") - 1))["end"]
    got = hit.select("debate", "id", "tag", raw_start.alias("a"), raw_end.alias("z")).join(own.select("debate", "id", "shift"), ["debate", "id"])
    return got.select("debate", "tag", (F.col("a") - F.col("shift")).alias("start"), (F.col("z") - F.col("shift")).alias("end"))
