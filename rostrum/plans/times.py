"""Interval, nearest-in-time and window-order queries on events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import intervals
from .registry import query

#: Two lists of periods; the last one is open.
PERIODS = [("P1", "1994-06-01", "1996-02-14"), ("P2", "1996-02-15", "1998-08-31"), ("P3", "1998-09-01", None)]
_P = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', {'NULL' if b is None else f'DATE {chr(39)}{b}{chr(39)}'})" for n, a, b in PERIODS) + ") p(name, first, last)"


def periods(spark):
    return spark.createDataFrame(PERIODS, "name string, first string, last string").select("name", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


@query(f"SELECT o_orderkey, p.name AS period FROM orders JOIN {_P} ON CAST(o_orderdate AS DATE) BETWEEN p.first AND coalesce(p.last, DATE '9999-12-31')")
def j10_period_of_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return intervals.in_period(o, "day", periods(spark)).select("o_orderkey", "period")


@query(f"""SELECT p.name AS period, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS todo, count(DISTINCT o_custkey) AS actors,
  floor(1000.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.5) / 10 AS saved_pct FROM orders JOIN {_P} ON CAST(o_orderdate AS DATE) BETWEEN p.first AND coalesce(p.last, DATE '9999-12-31') GROUP BY 1""")
def a19_workload_per_period(spark, sf_dir):
    from ..functions.maths import pct

    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", F.to_date("o_orderdate").alias("day"))
    n = lambda c: F.count(F.when(c, 1))
    done = F.col("o_orderstatus") == "F"
    g = intervals.in_period(o, "day", periods(spark)).groupBy("period").agg(F.count("*").alias("n"), n(done).alias("done"), n(~done).alias("todo"), F.countDistinct("o_custkey").alias("actors"))
    return g.select("*", pct(F.col("done"), F.col("n")).alias("saved_pct"))


@query("""WITH p AS (SELECT o_custkey AS list, o_orderkey AS name, CAST(o_orderdate AS DATE) AS first, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(30 * (o_orderkey % 5) AS INT) END AS last FROM orders)
  SELECT * FROM (SELECT *, lead(first) OVER (PARTITION BY list ORDER BY first, name) AS next_first FROM p) WHERE coalesce(last, DATE '9999-12-31') >= next_first""")
def w03_overlapping_periods(spark, sf_dir):
    first = F.to_date("o_orderdate")
    last = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.date_add(first, (30 * (F.col("o_orderkey") % 5)).cast("int")))
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("name"), first.alias("first"), last.alias("last"))
    return intervals.overlapping_periods(p, "list")


def marks(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


_SEC = "SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = '{}'"


@query(f"""WITH l AS ({_SEC.format('click')}), r AS ({_SEC.format('view')})
  SELECT l.event_id, r.event_id AS nearest_id, round(abs(r.t - l.t), 3) AS distance FROM l JOIN r ON l.user_id = r.user_id AND abs(r.t - l.t) <= 36000 QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.event_id) = 1""")
def j11_nearest_within_tolerance(spark, sf_dir):
    n = intervals.nearest(marks(spark, sf_dir, "click"), marks(spark, sf_dir, "view"), ["user_id"], "t", "t", "event_id", "event_id", 36000.0)
    return n.select("event_id", "nearest_id", F.round("distance", 3).alias("distance"))


@query("""WITH a AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS dur, o_custkey % 24 AS h FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT o_orderkey AS ck, CAST(o_orderdate AS DATE) AS d, o_totalprice AS cdur, o_custkey % 24 AS ch FROM orders WHERE o_orderstatus = 'O'),
  x AS (SELECT k, d, dur, h AS tod FROM a UNION ALL SELECT k, d - 1, dur, h + 24 FROM a WHERE h < 6)
  SELECT k, ck AS best, CAST(abs(ch - tod) AS BIGINT) AS gap FROM x JOIN c ON x.d = c.d WHERE abs(ch - tod) <= 5 AND greatest(dur, cdur) / least(dur, cdur) <= 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(ch - tod), ck) = 1""")
def j12_nearest_start_with_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice", (F.col("o_custkey") % 24).alias("h"), "o_orderstatus")
    # Late-night entries are also looked for on the day before, as hours past 24.
    late = F.when(F.col("h") < 6, F.array(F.struct(F.col("d"), F.col("h").alias("at")), F.struct(F.date_sub("d", 1).alias("d"), (F.col("h") + 24).alias("at")))).otherwise(F.array(F.struct(F.col("d"), F.col("h").alias("at"))))
    a = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("size"), F.inline(late).alias("day", "at"))
    c = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("d").alias("day"), F.col("o_totalprice").alias("size"), F.col("h").alias("at"))
    return intervals.nearest_of_like_size(a, c, 5, 2.0)


@query(r"""WITH b AS (SELECT item_id, DATE '2024-01-01' + CAST(item_id % 5 AS INT) AS d, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2)) AS w FROM benchmark), d AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 5 AS INT) AS d, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2)) AS w FROM documents WHERE lang = 'en'),
  p AS (SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) AS n, abs(d.d - b.d) AS gap FROM b JOIN d ON d.d BETWEEN b.d - 1 AND b.d + 1)
  SELECT item_id, doc_id, CAST(n AS BIGINT) AS common FROM p WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, gap, doc_id) = 1""")
def j13_closest_date_with_overlap(spark, sf_dir):
    from ..functions.text import title_words

    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 5).alias("day"), F.explode(title_words(F.col("text"))).alias("w"))
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", (F.col("doc_id") % 5).alias("dday"), F.explode(title_words(F.col("text"))).alias("w"))
    b = b.withColumn("dday", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)))
    n = b.join(d, ["w", "dday"]).groupBy("item_id", "day", "doc_id", "dday").agg(F.count("*").alias("n"))
    best = n.groupBy("item_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.abs(F.col("dday") - F.col("day")).alias("gap"), F.col("doc_id"))).alias("b"))
    return best.select("item_id", F.col("b.doc_id").alias("doc_id"), (-F.col("b.m")).alias("common"))


_SPANS = "(SELECT event_id AS id, user_id AS k, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 200 AS e FROM events WHERE event_type = '{}')"


def spans(spark, sf_dir, kind):
    e = marks(spark, sf_dir, kind).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 200).alias("end"))


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM {_SPANS.format('click')} a JOIN {_SPANS.format('view')} b ON a.k = b.k AND a.e >= b.s AND a.s <= b.e")
def j14_overlap_closed(spark, sf_dir):
    return intervals.overlaps(spans(spark, sf_dir, "click"), spans(spark, sf_dir, "view"), "k", 50000.0, closed=True).select("a_id", "b_id")


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM {_SPANS.format('click')} a JOIN {_SPANS.format('error')} b ON a.k = b.k AND a.e > b.s AND a.s < b.e")
def j15_overlap_half_open(spark, sf_dir):
    return intervals.overlaps(spans(spark, sf_dir, "click"), spans(spark, sf_dir, "error"), "k", 50000.0).select("a_id", "b_id")


@query(f"SELECT p.event_id, s.id AS active FROM ({_SEC.format('purchase')}) p JOIN {_SPANS.format('view')} s ON p.user_id = s.k AND p.t BETWEEN s.s AND s.e")
def j16_stabbing(spark, sf_dir):
    p = marks(spark, sf_dir, "purchase").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), F.col("t").alias("start"), F.col("t").alias("end"))
    return intervals.overlaps(p, spans(spark, sf_dir, "view"), "k", 50000.0, closed=True).select(F.col("a_id").alias("event_id"), F.col("b_id").alias("active"))


@query("""SELECT event_id, lead(event_id) OVER w AS next_id, lag(event_id) OVER w AS previous_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def j17_next_and_previous(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lead("event_id").over(w).alias("next_id"), F.lag("event_id").over(w).alias("previous_id"))


@query(f"SELECT DISTINCT l.event_id FROM ({_SEC.format('click')}) l WHERE EXISTS (SELECT 1 FROM ({_SEC.format('error')}) r WHERE r.user_id = l.user_id AND abs(r.t - l.t) <= 7200)")
def j18_event_near_span(spark, sf_dir):
    return intervals.nearest(marks(spark, sf_dir, "click"), marks(spark, sf_dir, "error"), ["user_id"], "t", "t", "event_id", "event_id", 7200.0).select("event_id")


@query("""SELECT event_id, round(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), max(t) OVER (PARTITION BY user_id) + 30) - t, 3) AS length FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events)""")
def j19_next_or_total_end(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    w = Window.partitionBy("user_id")
    end = F.coalesce(F.lead("t").over(w.orderBy("t")), F.max("t").over(w) + 30)
    return e.select("event_id", F.round(end - F.col("t"), 3).alias("length"))


@query("""WITH m AS (SELECT o_custkey AS c, o_orderpriority AS party, o_orderdate AS s, o_orderdate + INTERVAL 200 DAY AS e, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS t FROM orders WHERE o_orderstatus = 'O')
  SELECT k, party FROM q JOIN m ON q.c = m.c AND m.s <= q.t QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN q.t <= m.e THEN 0 ELSE 1 END, m.s DESC, m.id) = 1""")
def j20_membership_or_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("party"), F.col("o_orderdate").alias("s"), F.col("o_orderkey").alias("id"))
    q = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))
    # Of equally long memberships the one that began last also ends last, so it is both the active one and the fallback.
    w = Window.partitionBy("k").orderBy(F.desc("s"), "id")
    return q.join(m, "c").where("s <= t").withColumn("r", F.row_number().over(w)).where("r = 1").select("k", "party")


@query("""WITH s AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, lower(split_part(text, ' ', 2)) AS x, lower(split_part(text, ' ', 3)) AS y FROM conversations)
  SELECT r.conv_id, r.turn, count(*) AS candidates, min(s.turn) AS speech FROM r JOIN s ON s.conv_id = r.conv_id AND contains(s.t, r.x) AND contains(s.t, r.y) WHERE r.x <> '' AND r.y <> '' GROUP BY 1, 2""")
def j22_speech_match(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.where("role = 'user'").select("conv_id", F.col("turn").alias("s_turn"), F.lower("text").alias("t"))
    part = lambda i: F.lower(F.split_part("text", F.lit(" "), F.lit(i)))
    r = c.select("conv_id", "turn", part(2).alias("x"), part(3).alias("y")).where("x <> '' AND y <> ''")
    return r.join(s, "conv_id").where(F.contains("t", F.col("x")) & F.contains("t", F.col("y"))).groupBy("conv_id", "turn").agg(F.count("*").alias("candidates"), F.min("s_turn").alias("speech"))


@query(f"""WITH l AS ({_SEC.format('purchase')}), r AS ({_SEC.format('view')})
  SELECT l.event_id, (SELECT arg_max(r.event_id, (r.t, r.event_id)) FROM r WHERE r.user_id = l.user_id AND r.t <= l.t) AS previous_id FROM l""")
def w06_last_turn_before(spark, sf_dir):
    return intervals.last_before(marks(spark, sf_dir, "purchase"), marks(spark, sf_dir, "view"), ["user_id"], "t", "t", "event_id", "event_id")


@query("""WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
  SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def w07_runs(spark, sf_dir):
    return intervals.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""SELECT user_id, n, unnest(list_reduce(v, lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[-1] >= 46 THEN list_append(acc, x) ELSE acc END, CAST([] AS DOUBLE[]))) AS kept FROM (SELECT user_id, CAST(count(*) AS INT) AS n, list_sort(list(value)) AS v FROM events GROUP BY 1)""")
def w08_thinned_markers(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return e.select("user_id", F.size("v").alias("n"), F.explode(intervals.thinned(F.col("v"), 46.0)).alias("kept"))


@query("""WITH s AS (SELECT event_id AS id, user_id AS k, event_type AS t, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value + event_id % 90) AS BIGINT) AS z FROM events)
  SELECT id FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.k = x.k AND y.t = x.t AND y.id <> x.id AND y.a <= x.a AND y.z >= x.z AND (y.a < x.a OR y.z > x.z OR y.id < x.id))""")
def v09_drop_nested_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("event_id").alias("id"), "user_id", "event_type", F.floor("value").alias("start"), F.floor(F.col("value") + F.col("event_id") % 90).alias("end"))
    return intervals.drop_nested(s, ["user_id", "event_type"]).select("id")


@query("""WITH c AS (SELECT conv_id, turn, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS end_offset, CAST(length(text) AS BIGINT) AS n FROM conversations) SELECT conv_id, turn, end_offset, end_offset - n AS start_offset FROM c""")
def w02_running_offsets(spark, sf_dir):
    return intervals.running_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text")).select("conv_id", "turn", "end_offset", "start_offset")


@query(
    """WITH e AS (SELECT user_id, event_type, value - (event_id % 40) AS diff, event_id % 7 AS turn FROM events WHERE event_type IN ('click', 'view')), m AS (SELECT user_id, turn, min(diff) AS d FROM e GROUP BY 1, 2)
  SELECT user_id, count(*) AS turns, round(max(d) - min(d), 6) AS spread, round(median(d), 6) AS offset_s FROM m GROUP BY 1 HAVING count(*) >= 3 AND max(d) - min(d) <= 800"""
)
def c04_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select("user_id", (F.col("event_id") % 7).alias("turn"), (F.col("value") - F.col("event_id") % 40).alias("diff"))
    m = e.groupBy("user_id", "turn").agg(F.min("diff").alias("d"))
    g = m.groupBy("user_id").agg(F.count("*").alias("turns"), (F.max("d") - F.min("d")).alias("s"), F.median("d").alias("o"))
    return g.where("turns >= 3 AND s <= 800").select("user_id", "turns", F.round("s", 6).alias("spread"), F.round("o", 6).alias("offset_s"))


@query(
    f"""WITH l AS ({_SEC.format('click')}), r AS ({_SEC.format('view')}), a AS (SELECT l.event_id, l.user_id, l.t, r.t - l.t AS d FROM l JOIN r ON l.user_id = r.user_id AND abs(r.t - l.t) <= 36000 QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.event_id) = 1),
  f AS (SELECT user_id, median(d) AS m FROM a GROUP BY 1)
  SELECT l.event_id, CASE WHEN a.event_id IS NOT NULL THEN 'anchored' WHEN f.m IS NOT NULL THEN 'calibrated' ELSE 'none' END AS tier, round(coalesce(a.d, f.m), 3) AS shift FROM l LEFT JOIN a ON a.event_id = l.event_id LEFT JOIN f ON f.user_id = l.user_id"""
)
def c05_anchored_else_calibrated(spark, sf_dir):
    left, right = marks(spark, sf_dir, "click"), marks(spark, sf_dir, "view")
    near = intervals.nearest(left, right, ["user_id"], "t", "t", "event_id", "event_id", 36000.0)
    rt = right.select(F.col("event_id").alias("nearest_id"), F.col("t").alias("rt"))
    a = left.join(near, "event_id").join(rt, "nearest_id").select("event_id", "user_id", (F.col("rt") - F.col("t")).alias("d"))
    f = a.groupBy("user_id").agg(F.median("d").alias("m"))
    out = left.join(a.select("event_id", "d"), "event_id", "left").join(f, "user_id", "left")
    tier = F.when(F.col("d").isNotNull(), "anchored").when(F.col("m").isNotNull(), "calibrated").otherwise("none")
    return out.select("event_id", tier.alias("tier"), F.round(F.coalesce("d", "m"), 3).alias("shift"))


@query(
    """WITH e AS (SELECT event_id, user_id, value + CASE event_type WHEN 'purchase' THEN 300 WHEN 'error' THEN 150 ELSE 0 END AS base, ts FROM events), b AS (SELECT l.*, EXISTS (SELECT 1 FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'signup' AND abs(epoch_us(r.ts) - epoch_us(l.ts)) <= 20000000000) AS near FROM e l)
  SELECT user_id, event_id, round(base + CASE WHEN near THEN 50 ELSE 0 END, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY base + CASE WHEN near THEN 50 ELSE 0 END DESC, event_id) = 1"""
)
def c28_selection_score(spark, sf_dir):
    from ..operators.relational import best_per_group

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    # In whole microseconds: in seconds as doubles a distance of just the tolerance may come out above it.
    near = intervals.nearest(e, e.where("event_type = 'signup'"), ["user_id"], "t", "t", "event_id", "event_id", 20_000_000_000).select("event_id", F.lit(50).alias("bonus"))
    w = F.when(F.col("event_type") == "purchase", 300).when(F.col("event_type") == "error", 150).otherwise(0)
    s = e.join(near, "event_id", "left").select("user_id", "event_id", (F.col("value") + w + F.coalesce("bonus", F.lit(0))).alias("score"))
    return best_per_group(s, ["user_id"], [F.desc("score"), F.col("event_id")]).withColumn("score", F.round("score", 6))


_CH = "(SELECT item_id AS id, unnest(generate_series(item_id % 50, item_id % 50 + {n})) AS pos FROM benchmark)"


@query(f"""WITH p AS {_CH.format(n='30')}, g AS (SELECT item_id AS id, unnest(generate_series(item_id % 50 + item_id % 7 * 10, item_id % 50 + item_id % 7 * 10 + 20)) AS pos FROM benchmark), t AS (SELECT id, count(*) AS tp FROM p JOIN g USING (id, pos) GROUP BY 1)
  SELECT b.item_id, coalesce(tp, 0) AS tp, 31 - coalesce(tp, 0) AS fp, 21 - coalesce(tp, 0) AS fn FROM benchmark b LEFT JOIN t ON t.id = b.item_id""")
def c29_u04_span_evaluation(spark, sf_dir):
    from ..operators.spans import char_outcomes

    s = F.col("item_id") % 50
    g = s + F.col("item_id") % 7 * 10
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array(F.struct(s.alias("start"), (s + 31).alias("end"))).alias("p"), F.array(F.struct(g.alias("start"), (g + 21).alias("end"))).alias("g"))
    tp, fp, fn = char_outcomes(F.col("p"), F.col("g"))
    return b.select("item_id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


@query("SELECT l_orderkey AS speech, l_suppkey AS governor, min(l_linenumber) AS start, max(l_linenumber) AS stop, count(*) AS parts FROM lineitem GROUP BY 1, 2")
def c30_eval_records(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("speech"), F.col("l_suppkey").alias("governor")).agg(F.min("l_linenumber").alias("start"), F.max("l_linenumber").alias("stop"), F.count("*").alias("parts"))
