"""Fill-in-the-middle transformation by overlapping chunks. DataFrame functions only, no shuffle.

A text is cut into units (white space with the word behind it; white space at the end alone), and two ranks
drawn from a hash of the document's id say after how many units prefix and middle end.  The unit list itself is
never built.  A text falls into chunks of ``chunk`` characters that overlap by one, so whether a unit ends between two
adjacent characters (a word character, then white space) is decided inside one chunk; chunks are counted
independently of each other, running sums over their counts route each rank to the chunk that owns it,
and only that chunk is read again for the place of the cut.  Everything is linear in the text.

Chunks stay in their row: the output of a document is one string and its digest is sequential, so
moving chunks to other tasks would ship every text twice to save its shortest step.

Edge cases: a null text is empty, and an empty text is plain with 0 units; a text that contains a sentinel is plain,
so outputs can always be inverted; a text of one unit or of white space alone may have empty parts; a null doc_id is
hashed as no digits; equal rows give equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the sentinels (fixed values).
SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit ends between these two characters.
END = f"[^{SPACE}][{SPACE}]"


def overlapping_chunks(text: Column, chunk: int) -> Column:
    """Chunks of ``chunk`` characters, each with the first character of the next one behind it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{chunk + 1}}})).{{1,{chunk}}}"), F.lit(1))


def unit_ends(chunks: Column) -> Column:
    """Units that end between two adjacent characters, for each chunk."""
    return F.transform(chunks, lambda c: F.regexp_count(c, F.lit(END)).cast("long"))


def owner(ends: Column, rank: Column) -> Column:
    """(chunk, rank inside it) of the unit end number ``rank``, from running sums over the chunks' counts."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("before"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("rank"))

    def step(s: Column, n: Column) -> Column:
        here = (s["before"] < rank) & (rank <= s["before"] + n)
        return F.struct(
            (s["i"] + 1).alias("i"),
            (s["before"] + n).alias("before"),
            F.when(here, s["i"]).otherwise(s["chunk"]).alias("chunk"),
            F.when(here, rank - s["before"]).otherwise(s["rank"]).alias("rank"),
        )

    return F.aggregate(ends, start, step)


def place(chunks: Column, at: Column, chunk: int) -> Column:
    """Characters before the unit end that ``at`` names; reads that chunk alone."""
    units = F.split(F.get(chunks, at["chunk"]), f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return at["chunk"].cast("long") * chunk + F.length(F.array_join(F.slice(units, F.lit(1), at["rank"].cast("int")), ""))


def fill_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, chunk: int = 4096) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output."""
    text = F.col("text")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (
        F.when((text == "") | marked | (F.col("h")[2] % 100 >= fim_percent), "plain")
        .when(F.col("h")[3] % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    n = F.aggregate("ends", F.lit(0).cast("long"), lambda s, x: s + x) + F.when(text == "", 0).otherwise(1)
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", "text", F.array(*h).alias("h"), overlapping_chunks(text, chunk).alias("chunks"))
        .select("*", form.alias("form"), unit_ends(F.col("chunks")).alias("ends"))
        .select("*", n.alias("n"))
        .select("*", *[(F.col("h")[i] % (F.col("n") + 1)).alias(f"r{i}") for i in (0, 1)])
    )

    def cut(rank: Column) -> Column:
        inside = place(F.col("chunks"), owner(F.col("ends"), rank), chunk)
        return F.when(F.col("form") == "plain", None).when(rank == 0, 0).when(rank == F.col("n"), F.length("text")).otherwise(inside).cast("long")

    cuts = rows.select(
        "doc_id", "n", "form", "text", cut(F.least("r0", "r1")).alias("prefix_chars"), cut(F.greatest("r0", "r1")).alias("middle_end")
    )
    prefix = F.substr("text", F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substr("text", F.col("prefix_chars").cast("int") + 1, F.col("middle_chars").cast("int"))
    suffix = F.substr("text", F.col("middle_end").cast("int") + 1)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return cuts.withColumn("middle_chars", F.col("middle_end") - F.col("prefix_chars")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output")
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        two = F.locate(second, output, len(first) + 1)
        three = F.instr(F.substr(output, two), F.lit(MIDDLE)) + two - 1
        after = len(second)
        return (
            F.substr(output, F.lit(len(first) + 1), two - len(first) - 1),
            F.substr(output, two + after, three - two - after),
            F.substr(output, three + len(MIDDLE)),
        )

    pre, suf, mid = parts(PREFIX, SUFFIX)
    suf2, pre2, mid2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(pre, mid, suf)).when(form == "spm", F.concat(pre2, mid2, suf2)).otherwise(output)


def digest(docs: DataFrame, **options: int) -> DataFrame:
    """The transformation with digests of its output and of the text rebuilt from that output."""
    return fill_middle(docs, **options).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:], '') AS suf
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
