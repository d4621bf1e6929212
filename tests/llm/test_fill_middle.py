import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rostrum.llm import fill_middle

from .helpers import documents, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) from the list of units."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def awkward():
    texts = [None, "", " ", "\n\n", "a", " a", "a ", "a b", "é日🙂 \x0b\x0c x", "a<P>b c", "<S>", "x <M", "< <S <P", "no\x85break\xa0here 　y", "\x1c\x1d a"]
    texts += ["w " * 40 + t for t in ("", "<", "<S", "<P")] + ["🙂🙂 " * 30, "b" * 50, " " * 50]
    return [(i, t, None, None, None) for i, t in enumerate(texts * 12)] + [(None, "a b c", None, None, None)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_equals_unit_lists_for_every_chunk_size(spark, chunk):
    data = awkward() + documents()
    got = fill_middle.fill_middle(frame(spark, data, extra=True), chunk=chunk)
    back = got.withColumn("text", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(tuple(r))
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key)
    assert have == sorted(((d, *slow(d, t)) for d, t, *_ in data), key=key)
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in data)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_digest_repeats_and_empty_table(spark):
    assert fill_middle.digest(frame(spark, [])).count() == 0
    got = fill_middle.digest(frame(spark, [(7, "one two three", "en", "s", 1)] * 3)).collect()
    assert len(got) == 3 and len(set(got)) == 1
    assert got[0].restored_sha256 == hashlib.sha256(b"one two three").hexdigest()


def test_long_text_is_linear_and_plan_has_no_shuffle_or_python(spark):
    long = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word é\n"), 400_000).alias("text"))
    df = fill_middle.fill_middle(long, fim_percent=100)
    for r in df.collect():
        n, form, pre, mid, out = slow_long(r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pre, mid) and r.output == out
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def slow_long(doc_id):
    text = "word é\n" * 400_000
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def test_query_equals_sql(spark, sf):
    from rostrum.llm import queries

    from ..compare import compare, connect

    assert compare(spark, connect(sf), sf, queries.QUERIES["op11_fill_middle"], queries.ORACLE_SQL["op11_fill_middle"]) is None
