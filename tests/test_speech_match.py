"""Speech matching against plain search, with all outcomes and both ways to candidates."""

import random

from rostrum.operators import speech_match

SPEECHES = "speech int, speaker string, day int, year int, text string"
QUOTES = "quote int, speaker string, day int, year int, parts array<string>"


def slow(speeches, quotes):
    out = {}
    for q, speaker, day, year, parts in quotes:
        own = [s for s in speeches if speaker is not None and s[1] == speaker]
        near = [s for s in own if day is not None and s[2] == day] or [s for s in own if year is not None and s[3] == year]
        hits = [s[0] for s in near if parts and all(p is not None and p in s[4] for p in parts)]
        out[q] = ("not_found" if not hits else "unique" if len(hits) == 1 else "ambiguous", len(hits), min(hits, default=None))
    return out


def test_match_equals_plain_search(spark):
    rng = random.Random(1)
    vocab = ["voorzitter", "dank", "é", "u wel", "het", "plan,", "2024", "boeren", "stikstof", "ja"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    speeches = [(i, f"s{i % 3}", i % 7 if i % 5 else None, i % 2, text(rng.randint(0, 80))) for i in range(80)]
    speeches += [(100 + i, "s1", 3, 1, speeches[10][4]) for i in range(3)]
    quotes = []
    for q in range(300):
        s = rng.choice(speeches)
        t = s[4] or "x"
        a, n = rng.randrange(max(1, len(t) - 40)), rng.choice([0, 1, 3, 4, 8, 18, 19, 30, 60])
        parts = [t[a : a + n], t[: rng.randint(0, 12)]]
        if q % 9 == 0:
            parts[0] += " niemand"
        quotes.append((q, s[1], rng.choice([s[2], None, 99]), s[3], parts))
    quotes += [(900, None, 1, 1, ["het"]), (901, "s1", None, None, ["het"]), (902, "s1", 3, 1, []), (903, "s1", 3, 1, None), (904, "s1", 3, 1, ["het", None]), (905, "s9", 3, 1, ["het"]), (906, "s1", 3, 1, [""])]
    got = speech_match.match(spark.createDataFrame(speeches, SPEECHES), spark.createDataFrame(quotes, QUOTES)).collect()
    want = slow(speeches, quotes)
    assert len(got) == len(quotes)
    assert {r.quote: (r.outcome, r.candidates, r.speech) for r in got} == want
    assert {o for o, _, _ in want.values()} == {"unique", "ambiguous", "not_found"}


def test_records(spark):
    text = "Ik vind dat het anders moet, want boeren lijden. Dus stop. Alleen een dwaas zegt nee."
    speeches = spark.createDataFrame([(1, "A", 5, 2020, text), (2, "B", 5, 2020, text)], SPEECHES)
    cols = "quote int, speaker string, other string, kind string, target string, day int, year int, dependent string, governor string"
    relations = [
        (1, "A", "A", "Support", "Claim", 5, 2020, "boeren lijden", "het anders moet"), (2, "A", "A", "Support", "Claim", None, 2020, "Dus stop", "het anders moet"),
        (3, "A", "B", "Support", "Claim", 5, 2020, "Dus stop", "Ik vind"), (4, "A", "A", "Attack", "Claim", 5, 2020, "Dus stop", "Ik vind"), (5, "A", "A", "Support", "Premise", 5, 2020, "Dus stop", "Ik vind"),
    ]
    fallacies = [(1, "A", 5, 2020, "een dwaas zegt nee", "ad hominem"), (2, "A", 5, 2020, "dwaas", "ad hominem"), (3, "A", 5, 2020, "dwaas", "other"), (4, "B", 6, 2020, "Dus stop", "other"), (5, "B", 6, 2020, "nergens", "other")]
    got = speech_match.records(speeches, spark.createDataFrame(relations, cols), spark.createDataFrame(fallacies, "quote int, speaker string, day int, year int, text string, label string")).orderBy("speech").collect()
    cut = lambda s: text[s.start : s.end]
    assert [[cut(s) for s in r.spans] for r in got] == [["het anders moet, want boeren lijden. Dus stop"], []]
    assert [[(cut(f), f.label) for f in r.fallacies] for r in got] == [[("een dwaas zegt nee", "ad hominem"), ("dwaas", "other")], [("Dus stop", "other")]]


def test_no_side_is_broadcast(spark):
    # Files of grams are far smaller than their rows in memory, so their size says nothing.
    speeches = spark.createDataFrame([(i, "A", 5, 2020, f"een twee drie vier vijf zes {i}") for i in range(9)], SPEECHES)
    quotes = spark.createDataFrame([(i, "A", 5 if i % 2 else None, 2020, ["twee drie vier vijf zes", "n"] if i % 3 else ["t"]) for i in range(30)], QUOTES)
    got = speech_match.match(speeches, quotes)
    assert {(r.candidates, r.speech) for r in got.collect()} == {(9, 0)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
