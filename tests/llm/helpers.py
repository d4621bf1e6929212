"""Small documents with the awkward cases, shared by the tests of all operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def documents(seed=0, n=60):
    """Nulls in every column, empty and long texts, exact and near copies, a shared passage, ties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passage = words(rng, 60, vocab)
    rows = []
    for i in range(n):
        text = words(rng, rng.randint(1, 200), vocab)
        if i % 7 == 3:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        if i % 11 == 5 and i > 11:
            text = rows[i - 11][1]
        if i % 13 == 6 and i > 13:
            text = (rows[i - 13][1] or "") + " z"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(text or "")))
    rows[2] = (2, None, None, None, None)
    rows[4] = (4, "", "en", "s1", 0)
    rows[8] = (8, " \t\n\x0b ", "en", "s2", 5)
    rows[9] = (9, "x", "en", "s2", 1)
    rows[10] = (10, words(rng, 9000, vocab), "en", "s1", None)
    rows[12] = (12, "ab " * 500, "en", "s1", 1500)
    return rows


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    if extra:  # columns that clash with names the operators use inside
        from pyspark.sql import functions as F

        for c in ("size", "chunk", "bucket", "target", "h", "k", "fp", "shard", "rank", "position", "kept", "x0"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
