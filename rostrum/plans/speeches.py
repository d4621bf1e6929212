"""Quotes matched to speeches and the evaluation records on them, over conversations read as speeches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import speech_match
from .registry import query

# Twenty conversations share their two speakers; days repeat every 50 conversations, years every 3.  Quotes are words of a turn; of those some
# name no day, a day without speeches, or words that nobody said, and some are a letter that many speeches hold.


def _speeches(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    speaker = F.concat(F.col("role"), (F.col("conv_id") % 20).cast("string"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("speech"), speaker.alias("speaker"), (F.col("conv_id") % 50).alias("day"), (F.col("conv_id") % 3).alias("year"), "text")


def _quotes(spark, sf_dir) -> DataFrame:
    s = _speeches(spark, sf_dir)
    w, n = F.split("text", " "), F.col("speech")
    part = lambda a, k: F.array_join(F.slice(w, a, k), " ")
    dependent = F.when(n % 7 == 3, "zzz nobody said this").when(n % 10 == 2, F.substr("text", F.lit(1), F.lit(1))).otherwise(part(3, 5))
    governor = F.when(n % 10 == 2, F.substr("text", F.lit(2), F.lit(2))).otherwise(part(9, 4))
    day = F.when(n % 4 == 1, None).when(n % 4 == 2, F.col("day") + 1000).otherwise(F.col("day"))
    return s.select(n.alias("quote"), "speaker", day.alias("day"), "year", dependent.alias("dependent"), governor.alias("governor"))


_SQL = """s AS (SELECT conv_id * 100 + turn AS speech, role || CAST(conv_id % 20 AS VARCHAR) AS speaker, conv_id % 50 AS day, conv_id % 3 AS year, text, string_split(text, ' ') AS w FROM conversations),
  q AS (SELECT speech AS quote, speaker, CASE speech % 4 WHEN 1 THEN NULL WHEN 2 THEN day + 1000 ELSE day END AS day, year,
    CASE WHEN speech % 7 = 3 THEN 'zzz nobody said this' WHEN speech % 10 = 2 THEN substr(text, 1, 1) ELSE array_to_string(list_slice(w, 3, 7), ' ') END AS dependent,
    CASE WHEN speech % 10 = 2 THEN substr(text, 2, 2) ELSE array_to_string(list_slice(w, 9, 12), ' ') END AS governor FROM s),
  held AS (SELECT q.*, EXISTS (SELECT 1 FROM s WHERE s.speaker = q.speaker AND s.day = q.day) AS has_day FROM q)"""


@query(f"""WITH {_SQL}, hits AS (SELECT quote, speech FROM held q JOIN s ON s.speaker = q.speaker AND CASE WHEN has_day THEN s.day = q.day ELSE s.year = q.year END AND contains(s.text, dependent) AND contains(s.text, governor)),
  n AS (SELECT quote, count(*) AS candidates, min(speech) AS speech FROM hits GROUP BY 1)
  SELECT quote, CASE WHEN candidates IS NULL THEN 'not_found' WHEN candidates = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, coalesce(candidates, 0) AS candidates, speech FROM q LEFT JOIN n USING (quote)""")
def j22_quote_speeches(spark, sf_dir):
    q = _quotes(spark, sf_dir).withColumn("parts", F.array("dependent", "governor"))
    return speech_match.match(_speeches(spark, sf_dir), q)


@query(f"""WITH {_SQL}, r AS (SELECT * FROM held WHERE quote % 6 <> 0 AND quote % 8 <> 0), hits AS (SELECT r.quote, min(speech) AS speech FROM r JOIN s ON s.speaker = r.speaker AND CASE WHEN has_day THEN s.day = r.day ELSE s.year = r.year END AND contains(s.text, dependent) AND contains(s.text, governor) GROUP BY 1),
  placed AS (SELECT speech, governor, instr(text, dependent) - 1 AS a, instr(text, governor) - 1 AS b, length(dependent) AS na, length(governor) AS nb FROM hits JOIN r USING (quote) JOIN s USING (speech)),
  spans AS (SELECT DISTINCT speech, min(least(a, b)) AS x, max(greatest(a + na, b + nb)) AS y FROM placed GROUP BY speech, governor),
  f AS (SELECT r.quote, min(speech) AS speech FROM held r JOIN s ON s.speaker = r.speaker AND CASE WHEN has_day THEN s.day = r.day ELSE s.year = r.year END AND contains(s.text, governor) WHERE r.quote % 3 = 1 GROUP BY 1),
  fs AS (SELECT DISTINCT speech, 'L' || CAST(quote % 2 AS VARCHAR) AS label, instr(text, governor) - 1 AS x, instr(text, governor) - 1 + length(governor) AS y FROM f JOIN held USING (quote) JOIN s USING (speech)),
  kept AS (SELECT * FROM fs a WHERE NOT EXISTS (SELECT 1 FROM fs b WHERE b.speech = a.speech AND b.label = a.label AND b.x <= a.x AND b.y >= a.y AND (b.x < a.x OR b.y > a.y))),
  s1 AS (SELECT speech, string_agg(x || '-' || y, ' ' ORDER BY x, y) AS spans FROM spans GROUP BY 1), f1 AS (SELECT speech, string_agg(x || '-' || y || label, ' ' ORDER BY x, y, label) AS fallacies FROM kept GROUP BY 1)
  SELECT speech, coalesce(spans, '') AS spans, coalesce(fallacies, '') AS fallacies FROM s1 FULL JOIN f1 USING (speech)""")
def c30_speech_records(spark, sf_dir):
    q, n = _quotes(spark, sf_dir), F.col("quote")
    kind, target = F.when(n % 6 == 0, "Attack").otherwise("Support"), F.when(n % 8 == 0, "Premise").otherwise("Claim")
    relations = q.select("*", F.col("speaker").alias("other"), kind.alias("kind"), target.alias("target"))
    fallacies = q.where(n % 3 == 1).select("quote", "speaker", "day", "year", F.col("governor").alias("text"), F.concat(F.lit("L"), (n % 2).cast("string")).alias("label"))
    r = speech_match.records(_speeches(spark, sf_dir), relations, fallacies)
    line = lambda c, more: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), *[s[m] for m in more])), " ")
    return r.select("speech", line("spans", []).alias("spans"), line("fallacies", ["label"]).alias("fallacies"))
