"""Text, date and number functions, readability and term statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import spread, table
from ..functions import maths, temporal, text
from ..operators import aggregates as agg
from ..operators import term_lengths, terms
from .registry import query

VOWEL = "[aeiouyàáâäèéêëìíîïòóôöùúûü]+"
#: Readings of a text shared by several statements; DuckDB lower() and Spark agree on these texts.
_STATS = rf"""SELECT doc_id, lang, source, n_chars, CAST(len(w) AS INT) AS word_count,
  CAST(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(list_filter(string_split_regex(text, '[.!?]+(?:\s+|$)'), lambda s: regexp_matches(s, '\p{{L}}')))) END AS INT) AS sentence_count,
  CAST(coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '(?i){VOWEL}'))))), 0) AS INT) AS syllable_count,
  CAST(len(list_filter(w, lambda x: length(x) > 6)) AS INT) AS long_word_count, CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS INT) AS unique_word_count
  FROM (SELECT *, regexp_extract_all(text, '\p{{L}}+') AS w FROM documents)"""


def stats(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"))
    return docs.select("doc_id", "lang", "source", "n_chars", *[c.alias(n) for n, c in text.text_stats(F.col("text")).items()])


@query(f"SELECT doc_id, word_count, sentence_count, syllable_count, long_word_count, unique_word_count FROM ({_STATS})")
def x13_text_stats(spark, sf_dir):
    return stats(spark, sf_dir).select("doc_id", "word_count", "sentence_count", "syllable_count", "long_word_count", "unique_word_count")


@query(f"""SELECT doc_id, CASE WHEN word_count > 0 AND sentence_count > 0 THEN round(206.84 - 0.93 * word_count / sentence_count - 77.0 * syllable_count / word_count, 6) ELSE 0.0 END AS flesch,
  CASE WHEN word_count > 0 AND sentence_count > 0 THEN round(CAST(word_count AS DOUBLE) / sentence_count + 100.0 * long_word_count / word_count, 6) ELSE 0.0 END AS lix,
  CASE WHEN word_count > 0 THEN round(CAST(unique_word_count AS DOUBLE) / word_count, 9) ELSE 0.0 END AS ttr FROM ({_STATS})""")
def x15_readability(spark, sf_dir):
    n, s = F.col("word_count"), F.col("sentence_count")
    f, lx = text.flesch_douma(n, s, F.col("syllable_count")), text.lix(n, s, F.col("long_word_count"))
    return stats(spark, sf_dir).select("doc_id", F.round(f, 6).alias("flesch"), F.round(lx, 6).alias("lix"), F.round(maths.ratio(F.col("unique_word_count"), n), 9).alias("ttr"))


_VERB = f"""SELECT source AS party, count(*) AS turns, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(sentence_count) AS BIGINT) AS sentences,
  CAST(sum(syllable_count) AS BIGINT) AS syllables, CAST(sum(long_word_count) AS BIGINT) AS long_words, CAST(sum(unique_word_count) AS BIGINT) AS unique_words,
  count(*) FILTER (doc_id % 2 = 0) AS args, count(*) FILTER (doc_id % 3 = 0) AS claims, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END) AS BIGINT) AS quote_chars FROM ({_STATS}) GROUP BY 1"""


def verbosity(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    s = stats(spark, sf_dir).groupBy(F.col("source").alias("party")).agg(
        F.count("*").alias("turns"), F.sum("n_chars").alias("chars"), F.sum("word_count").alias("words"), F.sum("sentence_count").alias("sentences"),
        F.sum("syllable_count").alias("syllables"), F.sum("long_word_count").alias("long_words"), F.sum("unique_word_count").alias("unique_words"),
        n(F.col("doc_id") % 2 == 0).alias("args"), n(F.col("doc_id") % 3 == 0).alias("claims"), F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(0)).alias("quote_chars"),
    )
    return agg.verbosity(s)


@query(f"""SELECT party, turns, args, round(chars / turns, 6) AS chars_per_turn, round(words / sentences, 6) AS words_per_sentence, round(unique_words / words, 9) AS unique_share,
  round(1000 * args / chars, 9) AS args_per_1000_chars, CASE WHEN args = 0 THEN 0.0 ELSE round(claims / args, 9) END AS claims_per_arg, CASE WHEN args = 0 THEN 0.0 ELSE round(quote_chars / args, 6) END AS chars_per_quote,
  round(206.84 - 0.93 * words / sentences - 77 * syllables / words, 6) AS flesch_douma, round(words / sentences + 100 * long_words / words, 6) AS lix FROM ({_VERB.replace("BIGINT", "DOUBLE")})""")
def a04_verbosity(spark, sf_dir):
    v = verbosity(spark, sf_dir)
    six = ["chars_per_turn", "words_per_sentence", "chars_per_quote", "flesch_douma", "lix"]
    nine = ["unique_share", "args_per_1000_chars", "claims_per_arg"]
    return v.select("party", "turns", "args", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 9).alias(c) for c in nine])


@query(f"SELECT round(median(chars / turns), 6) AS chars_per_turn, round(median(words / sentences), 6) AS words_per_sentence, count(*) AS parties FROM ({_VERB.replace('BIGINT', 'DOUBLE')}) WHERE turns >= 5")
def a05_median_verbosity(spark, sf_dir):
    v = verbosity(spark, sf_dir).where("turns >= 5")
    return v.agg(*[F.round(agg.median(F.col(c)), 6).alias(c) for c in ("chars_per_turn", "words_per_sentence")], F.count("*").alias("parties"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def x01_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM conversations),
  o AS (SELECT *, CAST(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS end_offset FROM c),
  r AS (SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS running FROM c GROUP BY 1),
  q AS (SELECT conv_id, turn AS quote_turn, array_to_string(list_slice(string_split(t, ' '), 1, 6), ' ') AS needle FROM c),
  f AS (SELECT conv_id, quote_turn, instr(running, needle) - 1 AS pos FROM q JOIN r USING (conv_id) WHERE needle <> '')
  SELECT f.conv_id, f.quote_turn, CAST(pos AS BIGINT) AS pos, min(o.turn) AS cue_turn FROM f JOIN o ON o.conv_id = f.conv_id AND o.end_offset > pos WHERE pos >= 0 GROUP BY 1, 2, 3"""
)
def w02_x02_quote_offsets(spark, sf_dir):
    from ..operators import intervals

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("t"))
    cues = intervals.running_offsets(c, "conv_id", "turn", F.col("t")).select("conv_id", "turn", "end_offset")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ").alias("running"))
    q = c.select("conv_id", F.col("turn").alias("quote_turn"), F.array_join(F.slice(F.split("t", " "), 1, 6), " ").alias("needle")).where("needle <> ''")
    pos = q.join(whole, "conv_id").select("conv_id", "quote_turn", (F.expr("locate(needle, running)") - 1).cast("long").alias("pos")).where("pos >= 0")
    hit = pos.join(cues, "conv_id").where(F.col("end_offset") > F.col("pos"))
    return hit.groupBy("conv_id", "quote_turn", "pos").agg(F.min("turn").alias("cue_turn"))


@query(
    """WITH d AS (SELECT doc_id, text AS t, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN split_part(text, ' ', 3) WHEN 2 THEN 'zzzz' WHEN 3 THEN substr(text, 20, 30) ELSE ' ' END AS f FROM documents)
  SELECT doc_id, CASE WHEN f IS NULL OR trim(f) = '' THEN 'none' WHEN n = 1 THEN 'valid' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status
  FROM (SELECT *, CASE WHEN length(f) > 0 THEN (length(t) - length(replace(t, f, ''))) // length(f) ELSE 0 END AS n FROM d)"""
)
def x03_fragment_status(spark, sf_dir):
    third = F.coalesce(F.try_element_at(F.split("text", " "), F.lit(3)), F.lit(""))
    m = F.col("doc_id") % 5
    f = F.when(m == 0, F.lit(None)).when(m == 1, third).when(m == 2, "zzzz").when(m == 3, F.substring("text", 20, 30)).otherwise(" ")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), f.alias("f"))
    return d.select("doc_id", text.classify_fragment(F.col("f"), F.col("t")).alias("status"))


@query(
    r"""WITH q AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '^[^:\n]{1,80}:\s*', '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)
  SELECT conv_id, turn, CASE WHEN len(w) >= 4 THEN array_to_string(list_slice(w, 1, 10), ' ') END AS needle FROM q"""
)
def x05_opening_needle(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.opening_needle(F.col("text")).alias("needle"))


@query("""SELECT c_custkey, CASE WHEN starts_with(t, 'De voorzitter:') OR (instr(t, ':') BETWEEN 1 AND 61 AND contains(lower(substr(t, 1, instr(t, ':') - 1)), lower(c_name))) THEN ltrim(substr(t, instr(t, ':') + 1)) ELSE t END AS body
  FROM (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN 'De voorzitter: orde' WHEN 1 THEN 'Mevrouw ' || c_name || ' (X):  dank' ELSE 'geen naam: wel tekst' END AS t FROM customer)""")
def x06_strip_speaker(spark, sf_dir):
    m = F.col("c_custkey") % 3
    t = F.when(m == 0, "De voorzitter: orde").when(m == 1, F.concat(F.lit("Mevrouw "), F.col("c_name"), F.lit(" (X):  dank"))).otherwise("geen naam: wel tekst")
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_speaker(t, F.col("c_name")).alias("body"))


@query(r"""SELECT * FROM (SELECT CASE WHEN regexp_matches(n, '^(.*?) (van der|van den|van de|van ''t|van|de|den|der|ten|ter|te|el)$') THEN regexp_replace(n, '^(.*?) (van der|van den|van de|van ''t|van|de|den|der|ten|ter|te|el)$', '\2 \1') ELSE n END AS name, count(*) AS n FROM
  (SELECT CASE n_nationkey % 4 WHEN 0 THEN n_name || ' van der' WHEN 1 THEN n_name || ' de' WHEN 2 THEN n_name || ' van de' ELSE n_name END AS n FROM nation) GROUP BY 1)""")
def x07_name_particles(spark, sf_dir):
    m = F.col("n_nationkey") % 4
    n = F.concat("n_name", F.when(m == 0, " van der").when(m == 1, " de").when(m == 2, " van de").otherwise(""))
    return table(spark, sf_dir, "nation").select(text.name_order(n).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bouw' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS party FROM customer")
def x08_alias(spark, sf_dir):
    alias = F.create_map(*[F.lit(x) for x in ("BUILDING", "Bouw", "MACHINERY", "Machines")])
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.try_element_at(alias, F.col("c_mktsegment")), F.col("c_mktsegment")).alias("party"))


@query(r"SELECT p_partkey, regexp_replace(replace(p_brand, '#', ' - '), '\s*-\s*', '-', 'g') AS key, replace(replace(lower(p_type), '-', '_'), ' ', '_') AS field FROM part")
def x09_x10_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_key(F.replace("p_brand", F.lit("#"), F.lit(" - "))).alias("key"), text.field_name(F.col("p_type")).alias("field"))


@query("SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def x11_slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


def fnv_reference(s: str) -> str:
    h = 2166136261
    raw = s.encode("utf-16-be")
    for c in zip(raw[::2], raw[1::2], strict=True):
        h = (h ^ (c[0] << 8 | c[1])) * 16777619 % (1 << 32)
    digits = ""
    while h or not digits:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits


@query("SELECT page_id, lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a, c) * 16777619 % 4294967296), 36)) AS debate_id FROM pages")
def x12_fnv_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.fnv1a36(F.col("url")).alias("debate_id"))


@query("""WITH c AS (SELECT doc_id, list_transform(string_split(substr(text, 1, 60), ''), lambda c: CAST(unicode(c) AS BIGINT)) AS p FROM documents WHERE text IS NOT NULL),
  u AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN x < 65536 THEN [x] ELSE [55296 + ((x - 65536) >> 10), 56320 + ((x - 65536) & 1023)] END)) AS units FROM c)
  SELECT doc_id, lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), units), lambda a, x: xor(a, x) * 16777619 % 4294967296), 36)) AS id FROM u WHERE len(units) > 0""")
def x12_fnv_units(spark, sf_dir):
    head = F.substr("text", F.lit(1), F.lit(60))
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", text.fnv1a36(head).alias("id"))


@query("SELECT user_id, coalesce(upper(t[1][1]) || lower(substr(t[1], 2)), 'Overig') AS title FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY 1)")
def x16_term_title(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    return e.select("user_id", text.term_title(F.col("t")).alias("title"))


@query("SELECT DISTINCT word FROM (SELECT unnest([lower(c_mktsegment), CASE WHEN right(lower(c_mktsegment), 2) = 'en' THEN substr(lower(c_mktsegment), 1, length(c_mktsegment) - 2) END, CASE WHEN right(lower(c_mktsegment), 1) = 's' THEN substr(lower(c_mktsegment), 1, length(c_mktsegment) - 1) END]) AS word FROM customer) WHERE word IS NOT NULL")
def x17_name_stopwords(spark, sf_dir):
    w = F.lower("c_mktsegment")
    forms = F.array_compact(F.array(w, F.when(w.endswith("en"), F.expr("left(lower(c_mktsegment), length(c_mktsegment) - 2)")), F.when(w.endswith("s"), F.expr("left(lower(c_mktsegment), length(c_mktsegment) - 1)"))))
    return table(spark, sf_dir, "customer").select(F.explode(forms).alias("word")).distinct()


@query(r"""SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM benchmark)""")
def x18_bigrams(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.ngrams(w, 2)).alias("bigram"))


@query("SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, z - a) || CASE WHEN z < length(text) THEN '…' ELSE '' END AS ctx FROM (SELECT doc_id, text, greatest(doc_id % 300 - 40, 0) AS a, least(doc_id % 300 + 50, length(text)) AS z FROM documents) WHERE z > a")
def x19_context_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("s", (F.col("doc_id") % 300).cast("int"))
    d = d.where(F.least(F.col("s") + 50, F.length("text")) > F.greatest(F.col("s") - 40, F.lit(0)))
    return d.select("doc_id", text.context_window(F.col("text"), F.col("s"), F.col("s") + 10, 40).alias("ctx"))


@query(r"SELECT doc_id, round(greatest(len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) / 2.4, 1.0), 6) AS seconds FROM documents")
def x20_speaking_time(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.speaking_seconds(F.col("text")), 6).alias("seconds"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^[\p{Lu}\d"“'']') THEN '' ELSE '… ' END || t || CASE WHEN regexp_matches(t, '[.!?]$') THEN '' ELSE ' …' END AS shown FROM (SELECT doc_id, substr(text, CAST(1 + doc_id % 3 AS INT)) AS t FROM documents)""")
def x21_claim_display(spark, sf_dir):
    t = F.expr("substring(text, cast(1 + doc_id % 3 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", text.claim_display(F.col("t")).alias("shown"))


@query("""SELECT p_partkey, contains(lower(p_type), lower(split_part(p_brand, '#', 1))) OR contains(lower(split_part(p_brand, '#', 1)), lower(p_type)) AS tautology, len(string_split(p_type, ' ')) > 2 AS long_name FROM part""")
def x22_label_quality(spark, sf_dir):
    a, b = F.lower("p_type"), F.lower(F.split("p_brand", "#")[0])
    return table(spark, sf_dir, "part").select("p_partkey", (F.contains(a, b) | F.contains(b, a)).alias("tautology"), (F.size(F.split("p_type", " ")) > 2).alias("long_name"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and')))), ' ') AS words FROM benchmark")
def x23_title_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(text.title_words(F.col("text"), ["the", "and"])), " ").alias("words"))


@query("""SELECT event_id, CASE WHEN contains(m, ':') THEN regexp_extract(m, '^(.*):([^:]*)$', 1) ELSE m END AS model, CASE WHEN contains(m, ':') THEN regexp_extract(m, '^(.*):([^:]*)$', 2) END AS provider
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'org/' || event_type || ':fast' ELSE 'a:b:' || event_type END AS m FROM events)""")
def x24_split_provider(spark, sf_dir):
    k = F.col("event_id") % 3
    m = F.when(k == 0, F.col("event_type")).when(k == 1, F.concat(F.lit("org/"), "event_type", F.lit(":fast"))).otherwise(F.concat(F.lit("a:b:"), "event_type"))
    e = table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    a, b = text.split_provider(F.col("m"))
    return e.select("event_id", a.alias("model"), b.alias("provider"))


@query("""SELECT item_id, 'Topic: bench. Text: ' || text || '. Answer in JSON.' AS prompt, substr(sha256(text), 1, 12) AS version, substr(sha256(text), 1, 12) IS DISTINCT FROM CASE WHEN item_id % 2 = 0 THEN substr(sha256(text), 1, 12) END AS outdated FROM benchmark""")
def x25_x27_prompts(spark, sf_dir):
    v = text.content_version(F.col("text"))
    used = F.when(F.col("item_id") % 2 == 0, v)
    p = F.format_string("Topic: bench. Text: %s. Answer in JSON.", "text")
    return table(spark, sf_dir, "benchmark").select("item_id", p.alias("prompt"), v.alias("version"), (~v.eqNullSafe(used)).alias("outdated"))


@query(r"""SELECT page_id, upper(n[1]) || substr(n, 2) AS name FROM (SELECT page_id, replace(regexp_replace(list_extract(string_split(regexp_extract(url || '/x', '^[a-z]+://[^/]+(/[^?#]*)', 1), '/'), -2), '-\d{1,2}-\d{2}$', ''), '-', ' ') AS n FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) || '-12-30' AS url FROM pages))""")
def x28_debate_name(spark, sf_dir):
    u = F.concat(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("-12-30/x"))
    return table(spark, sf_dir, "pages").select("page_id", text.debate_name(u).alias("name"))


@query(r"""SELECT doc_id, trim(split_part(t, 'Pro:', 1)) AS intro, trim(split_part(split_part(t, 'Pro:', 2), 'Contra:', 1)) AS pro, trim(split_part(t, 'Contra:', 2)) AS contra FROM (SELECT doc_id, lang || ' intro Pro: ' || source || ' x Contra: ' || n_chars AS t FROM documents)""")
def x29_description_parts(spark, sf_dir):
    t = F.concat("lang", F.lit(" intro Pro: "), "source", F.lit(" x Contra: "), F.col("n_chars").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.trim(F.split_part("t", F.lit("Pro:"), F.lit(1))).alias("intro"), text.section(F.col("t"), "Pro:", ["Contra:"]).alias("pro"), text.section(F.col("t"), "Contra:", []).alias("contra"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown FROM (SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS s FROM events)""")
def x30_clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.col("value") * 20).alias("shown"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN contains(lower(p_type), 'misc') OR contains(lower(p_type), 'a') THEN 'vague' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END], lambda x: x IS NOT NULL), ',') AS notes FROM part""")
def x31_flag_notes(spark, sf_dir):
    low = F.lower("p_type")
    n = F.array_compact(F.array(F.when(F.col("p_size") < 5, "small"), F.when(low.contains("misc") | low.contains("a"), "vague"), F.when(F.col("p_retailprice") > 1500, "dear")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(n, ",").alias("notes"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'speak' WHEN 'view' THEN 'interrupt' END AS kind, CASE WHEN event_type IN ('click', 'view') AND user_id > 5 THEN 'https://video.example/' || user_id || '/' || event_type END AS url FROM events""")
def x32_d08_event_urls(spark, sf_dir):
    turn = F.when(F.col("event_type") == "click", "speech").when(F.col("event_type") == "view", "interruption")
    url = F.when(turn.isNotNull() & (F.col("user_id") > 5), F.concat_ws("/", F.lit("https://video.example"), F.col("user_id").cast("string"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", temporal.event_type(turn, F.lit(False)).alias("kind"), url.alias("url"))


# Dates


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN month(o_orderdate) BETWEEN 5 AND 8 THEN '+02:00' ELSE '+01:00' END AS iso FROM orders WHERE month(o_orderdate) NOT IN (3, 4, 9, 10)""")
def d01_local_offset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("month(o_orderdate) NOT IN (3, 4, 9, 10)")
    return o.select("o_orderkey", temporal.iso_with_offset(F.col("o_orderdate") + F.expr("INTERVAL 10 HOURS")).alias("iso"))


@query("SELECT event_id, strftime(date_trunc('second', ts) + to_seconds(CAST(floor(value * 300) AS BIGINT)), '%Y/%m/%d/%H-%M-%S') AS path FROM events")
def d02_thumbnail_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", temporal.thumbnail_path(F.col("ts"), F.col("value") * 300).alias("path"))


@query("SELECT event_id, round(epoch_us(ts - (min(ts) OVER (PARTITION BY user_id))) / 1e6, 6) AS seconds FROM (SELECT event_id, user_id, ts FROM events)".replace("epoch_us(ts - (min(ts) OVER (PARTITION BY user_id)))", "(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)))"))
def d03_seconds_since_start(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return e.select("event_id", F.round(temporal.seconds_between(first, F.col("ts")), 6).alias("seconds"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def d04_relative_cutoff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("cut"))
    return e.join(F.broadcast(top), F.col("ts") >= F.col("cut")).select("event_id")  # one row


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def d05_date_parts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def d06_parse_day(spark, sf_dir):
    sep = F.when(F.col("o_orderkey") % 4 == 0, "-").when(F.col("o_orderkey") % 4 == 1, "/").otherwise(".")
    d = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 4 < 3, F.concat(F.dayofmonth(d).cast("string"), sep, F.month(d).cast("string"), sep, F.year(d).cast("string"))).otherwise("31 foo 1999")
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.parse_day(s).alias("day"))


@query("""SELECT event_id, greatest(s - 1.5, 0.0) AS begin_at, greatest(8.0, least(18.0, e - greatest(s - 1.5, 0.0))) AS duration FROM (SELECT event_id, value AS s, value + event_id % 25 AS e FROM events)""")
def l13_clip_window(spark, sf_dir):
    a, d = temporal.clip_window(F.col("value"), F.col("value") + F.col("event_id") % 25)
    return table(spark, sf_dir, "events").select("event_id", a.alias("begin_at"), d.alias("duration"))


# Numbers


@query("SELECT p_partkey, floor(1000.0 * p_size / 50 + 0.5) / 10 AS half_up, round_even(p_size / 4.0, 0) AS bankers FROM part")
def m01_rounding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", maths.pct(F.col("p_size"), F.lit(50)).alias("half_up"), F.bround(F.col("p_size") / F.lit(4.0), 0).alias("bankers"))


@query("SELECT o_orderpriority, coalesce(round(median(o_totalprice), 6), 0.0) AS mid, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, list_sort(list(o_totalprice))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p95_floor FROM orders GROUP BY 1")
def m02_m03_percentiles(spark, sf_dir):
    n = F.count("*")
    at = (F.floor((n - 1) * 0.95) + 1).cast("int")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(agg.median(F.col("o_totalprice")), 6).alias("mid"), F.round(F.percentile("o_totalprice", F.lit(0.95)), 6).alias("p95"), F.element_at(F.array_sort(F.collect_list("o_totalprice")), at).alias("p95_floor")
    )


#: The sampling number of ``maths.uniform_from_id`` in SQL.
U = "((CAST(CAST('0x' || substr(md5('0:' || {id}), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0)"


@query(f"SELECT vec_id, {U.format(id='vec_id')} AS u, round(-ln({U.format(id='vec_id')}) / (1 + label), 9) AS key FROM embeddings")
def m04_uniform_from_id(spark, sf_dir):
    u = maths.uniform_from_id(F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", u.alias("u"), F.round(-F.ln(u) / (1 + F.col("label")), 9).alias("key"))


@query("SELECT vec_id, z, CAST(least(greatest(floor((x + 1) / 2 * pow(2, z)), 0), pow(2, z) - 1) AS INT) AS tx, CAST(least(greatest(floor((1 - y) / 2 * pow(2, z)), 0), pow(2, z) - 1) AS INT) AS ty FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, unnest([0, 1, 2, 3, 4]) AS z FROM embeddings)")
def m05_c22_tiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.explode(F.array(*map(F.lit, range(5)))).alias("z"))
    tx, ty = maths.tile(F.col("x"), F.col("y"), F.col("z"), -1.0, 1.0)
    return e.select("vec_id", "z", tx.alias("tx"), ty.alias("ty"))


@query("SELECT c_custkey, round(degrees(c_acctbal * 1000 / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(c_acctbal * 500 / 6378137.0)) - pi() / 2), 6) AS lat FROM customer")
def m05_lonlat(spark, sf_dir):
    a, b = maths.lonlat(F.col("c_acctbal") * 1000, F.col("c_acctbal") * 500)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(a, 6).alias("lon"), F.round(b, 6).alias("lat"))


@query("SELECT p_partkey, round(least(greatest(sqrt(0.2 / (pi() * (p_retailprice / 1e5))), 0.5), 6.0), 6) AS radius FROM part")
def m06_point_radius(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(maths.point_radius(F.col("p_retailprice") / 1e5, 0.2, 0.5, 6.0), 6).alias("radius"))


@query("""WITH s AS (SELECT avg(CAST(embedding[1] AS DOUBLE)) AS cx, avg(CAST(embedding[2] AS DOUBLE)) AS cy, quantile_cont(CAST(embedding[1] AS DOUBLE), 0.05) AS lo, quantile_cont(CAST(embedding[1] AS DOUBLE), 0.95) AS hi FROM embeddings)
  SELECT vec_id, round(cx + (x - cx) * cos(radians(30)) - (y - cy) * sin(radians(30)), 6) AS rx, round(cy + (x - cx) * sin(radians(30)) + (y - cy) * cos(radians(30)), 6) AS ry, round(least(greatest((x - lo) / (hi - lo), 0.0), 1.0), 6) AS clipped
  FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s""")
def m07_m09_rotate_clip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    s = e.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.percentile("x", F.lit(0.05)).alias("lo"), F.percentile("x", F.lit(0.95)).alias("hi"))
    rx, ry = maths.rotate(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), 30)
    c = F.least(F.greatest((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return e.crossJoin(F.broadcast(s)).select("vec_id", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), F.round(c, 6).alias("clipped"))  # one row of statistics


@query("""WITH p AS (SELECT p_partkey, (CAST(p_size AS DOUBLE) * 2 + 16) / 116 AS fy, CAST(p_partkey % 60 - 30 AS DOUBLE) AS a, CAST(p_partkey % 40 - 20 AS DOUBLE) AS b FROM part), f AS (SELECT p_partkey, fy + a / 500 AS fx, fy, fy - b / 200 AS fz FROM p),
  i AS (SELECT p_partkey, 0.95047 * CASE WHEN fx > 6.0/29 THEN fx * fx * fx ELSE 3 * pow(6.0/29, 2) * (fx - 4.0/29) END AS x, CASE WHEN fy > 6.0/29 THEN fy * fy * fy ELSE 3 * pow(6.0/29, 2) * (fy - 4.0/29) END AS y, 1.08883 * CASE WHEN fz > 6.0/29 THEN fz * fz * fz ELSE 3 * pow(6.0/29, 2) * (fz - 4.0/29) END AS z FROM f),
  l AS (SELECT p_partkey, [3.2404542 * x - 1.5371385 * y - 0.4985314 * z, -0.969266 * x + 1.8760108 * y + 0.041556 * z, 0.0556434 * x - 0.2040259 * y + 1.0572252 * z] AS v FROM i),
  e AS (SELECT p_partkey, list_transform(v, lambda c: CAST(round(255 * least(greatest(CASE WHEN c <= 0.0031308 THEN 12.92 * c ELSE 1.055 * pow(greatest(c, 0.0), 1 / 2.4) - 0.055 END, 0.0), 1.0)) AS INT)) AS w FROM l)
  SELECT p_partkey, w[1] AS r, w[2] AS g, w[3] AS b FROM e""")
def m08_lab_to_rgb(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r, g, b = maths.lab_to_rgb(F.col("p_size").cast("double") * 2, F.col("p_partkey") % 60 - 30.0, F.col("p_partkey") % 40 - 20.0)
    return p.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT p_partkey, CAST(p_partkey * 7 % 12 AS BIGINT) AS palette FROM part")
def m11_palette(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.pmod(F.col("p_partkey") * 7, F.lit(12)).alias("palette"))


@query("""SELECT o_orderkey, p * CASE WHEN r <= 1 THEN 1.0 WHEN r <= 2 THEN 2.0 WHEN r <= 2.5 THEN 2.5 WHEN r <= 5 THEN 5.0 ELSE 10.0 END AS top, round(100 * sqrt(o_totalprice / max(o_totalprice) OVER ()), 6) AS width
  FROM (SELECT *, pow(10.0, floor(log10(o_totalprice))) AS p, o_totalprice / pow(10.0, floor(log10(o_totalprice))) AS r FROM orders)""")
def m12_m13_scales(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    most = o.agg(F.max("o_totalprice").alias("most"))
    top = F.col("most")
    return o.crossJoin(F.broadcast(most)).select("o_orderkey", maths.nice_ceiling(F.col("o_totalprice")).alias("top"), F.round(maths.sqrt_width(F.col("o_totalprice"), top), 6).alias("width"))


# JSON


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 2""")
def j1_json_from_fence(spark, sf_dir):
    from ..functions import jsons

    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(m == 1, F.concat(F.lit("x "), "props", F.lit(" y"))).otherwise(F.expr("left(props, length(props) - 1)"))
    e = table(spark, sf_dir, "events").select("event_id", jsons.extract(raw, "k bigint").alias("j"))
    return e.where("j IS NOT NULL").select("event_id", "j.k")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS tag, CASE WHEN event_id % 3 = 1 THEN 'why' END AS reason FROM events""")
def j2_tag_coercion(spark, sf_dir):
    from ..functions import jsons

    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(m == 1, F.concat(F.lit('{"tag": "'), "event_type", F.lit('", "reason": "why"}'))).otherwise("null")
    e = table(spark, sf_dir, "events").select("event_id", jsons.coerce_tag(raw).alias("t"))
    return e.select("event_id", "t.tag", "t.reason")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def j3_json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.*")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def j4_map_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode(F.map_entries("m")).alias("e")).select("user_id", F.col("e.key").alias("event_type"), F.col("e.value").alias("n"))


# Terms

_TOK = r"(SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{3,}')) AS term FROM documents)"


@query(f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM {_TOK} GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
  w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n WHERE df >= 3 AND df <= 0.25 * n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
  SELECT doc_id, term, round(w / l, 7) AS weight FROM w JOIN l USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(w / l, 7) DESC, term) <= 5""")
def c15_tfidf(spark, sf_dir):
    t = terms.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", 3)
    w = terms.tfidf(t, table(spark, sf_dir, "documents").count(), 3, 0.25)
    from ..operators.relational import best_per_group

    return best_per_group(w.withColumn("weight", F.round("weight", 7)), ["doc_id"], [F.desc("weight"), F.col("term")], 5)


@query(f"""WITH t AS (SELECT DISTINCT doc_id, lang, term FROM {_TOK}), c AS (SELECT term, count(*) FILTER (lang = 'de') AS a, count(*) AS b FROM t GROUP BY 1), n AS (SELECT count(*) FILTER (lang = 'de') AS na, count(*) AS nb FROM documents)
  SELECT term, round(a * 1.0 / na - b * 1.0 / nb, 9) AS contrast FROM c, n WHERE b >= 3 ORDER BY contrast DESC, term LIMIT 25""")
def c15_contrastive_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return terms.contrast(terms.tokens(d, "doc_id", "text", 3), d.select("doc_id", (F.col("lang") == "de").alias("inside")), 3).orderBy(F.desc("contrast"), "term").limit(25)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]{3,}') AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  t AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
  x AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n WHERE df >= 3 AND df <= 0.25 * n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1),
  m AS (SELECT doc_id, lang AS parent, lang || '/' || source AS child FROM documents), s AS (SELECT parent, child, count(*) AS own FROM m WHERE child IS NOT NULL GROUP BY 1, 2), sp AS (SELECT parent, sum(own) AS every FROM s GROUP BY 1),
  c AS (SELECT parent, child, term, sum(w / l) AS w FROM x JOIN l USING (doc_id) JOIN m USING (doc_id) WHERE child IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT parent, term, sum(w) AS pw FROM c GROUP BY 1, 2),
  r AS (SELECT child, term, round(w / own - pw / every, 9) AS contrast FROM c JOIN p USING (parent, term) JOIN s USING (parent, child) JOIN sp USING (parent))
  SELECT child, term, contrast FROM r WHERE contrast > 0 QUALIFY row_number() OVER (PARTITION BY child ORDER BY contrast DESC, term) <= 6""")
def c15_contrast_weights(spark, sf_dir):
    """Words and pairs that tell the documents of a language and source from those of the language."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", "text", F.col("lang").alias("parent"), F.concat("lang", F.lit("/"), "source").alias("child"))
    return term_lengths.contrast_terms(d, "doc_id", "text", 3, d.count(), 3, 0.25, 6)


@query(f"""WITH t AS (SELECT DISTINCT doc_id, term FROM {_TOK}), p AS (SELECT vec_id AS doc_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), g AS (SELECT sqrt(var_pop(x) + var_pop(y)) AS s FROM p)
  SELECT term, df, round(d / s, 7) AS dispersion FROM (SELECT term, count(*) AS df, sqrt(var_pop(x) + var_pop(y)) AS d FROM t JOIN p USING (doc_id) GROUP BY 1 HAVING count(*) >= 5), g WHERE d / s > 0.55""")
def c14_diffuse_terms(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return terms.diffuse(terms.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", 3), p, 5, 0.55)


_PAIRS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query(f"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}') AS w FROM documents), bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}') AS w FROM benchmark),
  t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_PAIRS}) AS term FROM dw) GROUP BY 1, 2), q AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_PAIRS}) AS term FROM bw) GROUP BY 1, 2),
  n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
  tw AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n), qw AS (SELECT item_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM q JOIN d USING (term), n),
  tn AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM tw GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY 1),
  s AS (SELECT item_id, doc_id, round(sum(tw.w * qw.w) / any_value(tn.l) / any_value(qn.l), 7) AS score FROM tw JOIN qw USING (term) JOIN tn USING (doc_id) JOIN qn USING (item_id) GROUP BY 1, 2)
  SELECT item_id, doc_id, score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1""")
def j30_best_title_match(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return term_lengths.best_match(b, d, "item_id", "doc_id", "text", 3, d.count(), 0.1)
