"""Spans of quotes on the video's clock: every tier and limit, and the index against plain search."""

import random

import pytest

from rostrum.operators import calibration

CUES = "debate int, seq int, start double, end double, text string"
QUOTES = "debate int, turn int, id int, quote string"
TURNS = "debate int, turn int, person string, kind string, expected double, text string"
EVENTS = "debate int, event int, person string, kind string, at double"


def norm(text):
    import re

    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def slow_find(cues, quote):
    """(place, start, end) by search in the joined text."""
    body, owners = "", []
    for i, (_, _, start, end, text) in enumerate(sorted(cues, key=lambda c: c[1])):
        t = norm(text)
        body += (" " if i else "") + t
        owners += [(start, end)] * (len(t) + 1)
    needle = norm(quote)
    p = body.find(needle)
    return (p, owners[p][0], owners[p + len(needle) - 1][1]) if needle and p >= 0 else None


@pytest.mark.parametrize("width", [7, 512])
def test_index_equals_plain_search(spark, width):
    rng = random.Random(width)
    vocab = ["dank", "u", "wel", "voorzitter", "a", "de", "ik", "zeg", "12", "nee,", "é", "--", "Ja!", "meer", "minder"]
    cues, quotes = [], []
    for d in range(4):
        own = [(d, s, 10.0 * s, 10.0 * s + 9, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for s in range(40)]
        cues += own
        body = " ".join(t for *_, t in own)
        for i in range(60):
            a = rng.randrange(len(body) - 60)
            text = body[a : a + rng.choice([1, 2, 3, 5, 10, 22, 23, 24, 60])]
            quotes.append((d, 0, d * 1000 + i, text if i % 5 else text[:10] + " zz " + text[10:]))
        quotes += [(d, 0, d * 1000 + 900, None), (d, 0, d * 1000 + 901, " .-"), (d, 0, d * 1000 + 902, "dank u")]
    running = calibration.running_cues(spark.createDataFrame(cues, CUES))
    got = {r.id: (r["at"], r.raw_start, r.raw_end) for r in calibration.find_spans(running, spark.createDataFrame(quotes, QUOTES), width).collect()}
    want = {i: slow_find([c for c in cues if c[0] == d], q) for d, _, i, q in quotes}
    assert got == {i: s for i, s in want.items() if s}
    assert len(got) > 100


def debate(d, offset, texts):
    return [(d, i, 10.0 * i + offset, 10.0 * i + 10 + offset, t) for i, t in enumerate(texts)]


LINES = ["goedemorgen allemaal dank u wel", "het plan is te duur voor iedereen", "wij steunen de motie van harte", "de minister weigert elk antwoord", "boeren verdienen een eerlijke prijs", "en dat was mijn laatste punt"]


def spans(df):
    return {r.id: (round(r.start, 3), round(r.end, 3), r.tier) for r in df.collect()}


def shared(spark, expected, offset=100.0):
    cues = spark.createDataFrame(debate(1, offset, LINES), CUES)
    quotes = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(LINES[: len(expected)])], QUOTES)
    turns = spark.createDataFrame([(1, i, None, None, e, None) for i, e in enumerate(expected)], TURNS)
    return spans(calibration.calibrate(cues, quotes, turns))


def test_one_shift_a_debate(spark):
    assert shared(spark, [0.0, 10.0, 21.0]) == {i: (10.0 * i, 10.0 * i + 10, "debate") for i in range(3)}  # median of 100, 100, 99
    assert shared(spark, [0.0, 10.0]) == {}  # two turns are too few
    assert shared(spark, [0.0, 10.0, None]) == {}
    assert shared(spark, [0.0, 10.0, None, 30.0])[2] == (20.0, 30.0, "debate")  # a turn without time is shifted, too
    assert shared(spark, [0.0, 10.0, 820.0]) != {}  # they differ by 800
    assert shared(spark, [0.0, 10.0, 821.0]) == {}


def test_only_the_first_quote_of_a_turn_counts(spark):
    cues = spark.createDataFrame(debate(1, 50.0, LINES), CUES)
    quotes = spark.createDataFrame([(1, 0, 0, LINES[0]), (1, 0, 1, LINES[2]), (1, 1, 2, LINES[3]), (1, 2, 3, LINES[4]), (1, 2, 4, LINES[5])], QUOTES)
    turns = spark.createDataFrame([(1, 0, None, None, 0.0, None), (1, 1, None, None, 30.0, None), (1, 2, None, None, 40.0, None)], TURNS)
    got = spans(calibration.calibrate(cues, quotes, turns))
    assert {i: s for i, (s, _, _) in got.items()} == {0: 0.0, 1: 20.0, 2: 30.0, 3: 40.0, 4: 50.0}


def anchored(spark, quote, text, expected=1010.0, event=(1, 5, "guid-a", "speaker", 1000.0), person="guid-a"):
    cues = spark.createDataFrame(debate(1, 300.0, LINES), CUES)
    quotes = spark.createDataFrame([(1, 0, 7, quote)], QUOTES)
    turns = spark.createDataFrame([(1, 0, person, "speaker", expected, text)], TURNS)
    return spans(calibration.calibrate(cues, quotes, turns, spark.createDataFrame([event, (1, 6, "guid-b", "speaker", 1010.0), (1, 8, "guid-a", "interrupter", 1010.0)], EVENTS)))


def test_tiers_of_an_anchored_turn(spark):
    head = "Mevrouw X (BBB): Goedemorgen allemaal, dank u wel."
    assert anchored(spark, LINES[2], head) == {7: (1020.0, 1030.0, "opening")}  # the turn begins two cues before the quote
    assert anchored(spark, LINES[2], "niet te vinden woorden hier") == {7: (1000.0, 1010.0, "first_quote")}
    assert anchored(spark, LINES[2], "te kort ja") == {7: (1000.0, 1010.0, "first_quote")}
    assert anchored(spark, "twaalf woorden die nergens staan " * 3, head) == {7: (1000.0, round(1000 + 15 / 2.4, 3), "estimate")}
    assert anchored(spark, "onzin", head) == {7: (1000.0, 1001.0, "estimate")}


def test_no_anchor_outside_the_window_or_without_person_or_time(spark):
    for odd in ({"expected": 1181.0}, {"expected": None}, {"person": None}, {"event": (1, 5, "guid-a", "chairman", 1000.0)}, {"event": (1, 5, "guid-a", "speaker", None)}):
        assert anchored(spark, LINES[2], "x", **odd) == {}  # and one turn is too few for a shared shift
    assert anchored(spark, LINES[2], "x", expected=1180.0) == {7: (1000.0, 1010.0, "first_quote")}


def test_nearest_event_of_the_speaker(spark):
    turns = spark.createDataFrame([(1, 0, "a", "speaker", 1010.0, None), (1, 1, "a", "speaker", 2990.0, None), (1, 2, "a", "interrupter", 1000.0, None)], TURNS)
    events = spark.createDataFrame([(1, 1, "a", "speaker", 1000.0), (1, 2, "b", "interrupter", 2000.0), (1, 3, "a", "speaker", 3000.0)], EVENTS)
    assert {r.turn: r.anchor for r in calibration.anchors(turns, events).collect()} == {0: 1000.0, 1: 3000.0}


def test_fragments_stay_inside_their_argument(spark):
    lines = ["eerst komt dit woord", "het plan is te duur", "voor iedereen en altijd", "het plan is goed"]
    cues = spark.createDataFrame([(1, i, 20.0 * i, 20.0 * i + 10, t) for i, t in enumerate(lines)], CUES)
    arguments = spark.createDataFrame([(1, 3, "Het plan is te duur voor iedereen en altijd!", 5.0), (1, 4, "staat nergens", 1.0)], "debate int, id int, quote string, start double")
    tags = [(1, 3, 1, "te duur voor"), (1, 3, 2, "plan ... iedereen"), (1, 3, 3, "plan … goed"), (1, 3, 4, "iedereen...plan"), (1, 3, 5, "..."), (1, 3, 6, None), (1, 3, 7, "altijd"), (1, 4, 8, "plan"), (1, 3, 9, "eerst")]
    got = calibration.fragment_spans(cues, arguments, spark.createDataFrame(tags, "debate int, id int, tag int, fragment string"))
    assert {r.tag: (r.start, r.end) for r in got.collect()} == {1: (5.0, 35.0), 2: (5.0, 35.0), 7: (25.0, 35.0)}


def test_empty_tables(spark):
    none = calibration.calibrate(spark.createDataFrame([], CUES), spark.createDataFrame([], QUOTES), spark.createDataFrame([], TURNS), spark.createDataFrame([], EVENTS))
    assert none.count() == 0
