"""Rows of one doc_id, or of none, get each its own decision in every stage that returns rows."""

from collections import Counter

from rostrum.llm import mixing, quality, simhash

from .helpers import frame


def test_mix_takes_every_row_by_itself(spark):
    ids = [1] * 6 + [None] * 5 + [2, 3]
    docs = [(k, " ".join(f"t{i}w{j}" for j in range(5 + i)), "en", "x" if i % 2 else "y", None) for i, k in enumerate(ids)]
    df = frame(spark, docs, extra=True)
    out = mixing.mix(df).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.mix_totals(df).collect())
    assert max(Counter(r.text.split()[0] for r in out).values()) <= 3
    assert len({r.text.split()[0] for r in out if r.doc_id == 1}) > 1 and {r.chunk for r in out} == {"clash"}


def test_quality_judges_every_row_by_itself(spark):
    good = lambda i: " ".join(f"{chr(97 + i % 26)}{j}" for j in range(60 + i))
    docs = [(k, t, None, None, None) for i in range(8) for k in (None, 5) for t in (good(i), "too short")]
    kept = quality.keep(frame(spark, docs, extra=True)).collect()
    assert len(kept) == 16 and all(len(r.text.split()) >= 50 for r in kept)


def test_simhash_keeps_one_row_of_a_group(spark):
    texts = ["a b c d e f", "q r s t u v w"]
    docs = [(k, t, None, None, None) for t in texts for k in (None, None, 4, 4)] + [(None, "alone here in null", None, None, None)]
    kept = simhash.keep_one(frame(spark, docs, extra=True)).collect()
    assert sorted(((r.text, r.doc_id) for r in kept), key=repr) == [("a b c d e f", 4), ("alone here in null", None), ("q r s t u v w", 4)]
