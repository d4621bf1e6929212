"""Only speeches that hold a whole gram of a quote are read for it, and quotes of one number are one quote."""

import random

from rostrum.operators import speech_match

from .test_speech_match import QUOTES, SPEECHES


def test_candidates_hold_a_gram_of_the_quote(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(30)]
    made, plain = {}, speech_match.scratch

    def scratch(df, tag, *more):
        made.setdefault(tag, []).append(plain(df, tag, *more))
        return made[tag][-1]

    monkeypatch.setattr(speech_match, "scratch", scratch)
    quotes = [(1, "A", 5, 2020, [texts[7][50:90]]), (2, "A", 6, 2020, [texts[9][3:17]])]
    got = speech_match.match(spark.createDataFrame([(i, "A", 5, 2020, t) for i, t in enumerate(texts)], SPEECHES), spark.createDataFrame(quotes, QUOTES))
    assert {(r.quote, r.outcome, r.speech) for r in got.collect()} == {(1, "unique", 7), (2, "unique", 9)}
    assert {r.speech for held in made["grams"] for r in held.collect()} == {7, 9}


def test_quotes_of_one_number(spark):
    speeches = [(1, "A", 5, 2020, "een lang verhaal over boeren"), (2, "B", 6, 2020, "een kort verhaal over stikstof"), (3, "B", 6, 2020, "niets")]
    quotes = [(1, "A", 5, 2020, ["verhaal over boeren"]), (1, "B", 9, 2020, ["verhaal over stikstof"]), (2, "B", 6, 2020, ["niets"])]
    got = speech_match.match(spark.createDataFrame(speeches, SPEECHES), spark.createDataFrame(quotes, QUOTES)).collect()
    assert sorted((r.quote, r.outcome, r.candidates, r.speech) for r in got) == [(1, "ambiguous", 2, 1)] * 2 + [(2, "unique", 1, 3)]
