"""Token counts per document move whole texts, not tokens."""

import re

from rostrum.operators import terms


def test_counts_per_document_need_one_exchange(spark):
    docs = spark.createDataFrame([(i, "the red fox and the dog " * 3) for i in range(40)] + [(0, "the cat")], "doc_id long, text string")
    for toks in (terms.tokens(docs, "doc_id", "text", 3), terms.with_pairs(docs, "doc_id", "text", 3)):
        tf = toks.groupBy("id", "term").count()
        plan = tf._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) == 1
        assert {(r.id, r.term): r["count"] for r in tf.collect()}[0, "the"] == 7
