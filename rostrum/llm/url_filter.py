"""URL filter: rules by longest match, and trust and distrust propagated over links between hosts.

``judge`` splits every url into host and path.  The longest rule that fits decides; where none fits,
the host is judged by its links: a personalised PageRank from trusted seeds along links, and one of
distrust from blocked seeds against them (who links to a blocked host earns distrust).  A host is
blocked if its distrust is at least ``threshold`` times the seeds' mean share and exceeds its trust.
Seeds are the hosts on which a rule allows or blocks something.

Edges are distinct pairs of hosts (one page's absolute links, pre-aggregated before the exchange),
weighted by the number of linking pages.  All rank vectors live in DataFrames, written to the shared
folder every round; the graph never reaches the driver, and rounds end when the ranks stand still.

Edge cases: a null url, or one without ``://``, has empty host and path and is allowed; a null or
empty html has no links; hosts without links keep rank zero; with no edges or no seeds nothing
but rules blocks; repeated rows are judged alike; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch

#: (host, path, verdict); a rule fits its host and all subdomains and paths that start with its own.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = r"^[\s\S]*?://"
    has = url.contains("://")
    host = F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, rest + r"[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits, nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of one host that link to another host, for every pair that occurs."""
    links = F.expr(r"""regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["\']?(https?://[^"\'\\s>]+)', 1)""")
    page = pages.select(url_parts(F.col("url"))[0].alias("src"), F.array_distinct(F.transform(links, lambda u: url_parts(u)[0])).alias("to"))
    return page.select("src", F.explode("to").alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """host, rank: PageRank along (src, dst, n), restarting at ``seeds`` (host), which share rank 1."""
    n = seeds.count()
    rank = scratch(seeds.select("host", F.lit(1.0 / max(n, 1)).alias("rank")), "rank")
    if not n or edges.isEmpty():
        return rank
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    step = scratch(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")), "links")
    start = seeds.select("host", F.lit((1 - damping) / n).alias("rank"))
    for _ in range(rounds):
        moved = step.join(rank, step["src"] == rank["host"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("w") * F.col("rank")) * damping).alias("rank"))
        new = scratch(moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        both = new.join(rank.withColumnRenamed("rank", "old"), "host", "full")
        change = both.agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        drop_scratch(rank)
        rank = new
        if change < tolerance:
            break
    return rank


def host_verdicts(pages: DataFrame, rules=RULES, threshold: float = 0.05, **options) -> DataFrame:
    """host, trust, distrust, blocked for every host with rank; hosts not listed are allowed."""
    host, path = url_parts(F.col("url"))
    _, verdict = rule_for(host, path, rules)
    seen = pages.select(host.alias("host"), verdict.alias("v")).where("host <> ''").groupBy("host").agg(
        F.max(F.col("v") == "allow").alias("good"), F.max(F.col("v") == "block").alias("bad")
    )
    # A host with rules both ways is a seed of neither kind.
    seen = scratch(seen.where("coalesce(good, false) <> coalesce(bad, false)"), "seeds")
    good, bad = seen.where("good").select("host"), seen.where("bad").select("host")
    edges = scratch(host_edges(pages), "edges")
    trust = page_rank(edges, good, **options).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = page_rank(back, bad, **options).withColumnRenamed("rank", "distrust")
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    n = max(1, bad.count())
    # Seeds themselves are judged by their rules alone: a host is not blocked for one blocked path.
    marked = both.join(bad.withColumn("seed", F.lit(True)), "host", "left")
    return marked.select("host", "trust", "distrust", (F.col("seed").isNull() & (F.col("distrust") >= threshold / n) & (F.col("distrust") > F.col("trust"))).alias("blocked"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.05, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of ``pages``."""
    blocked = host_verdicts(pages, rules, threshold, **options).where("blocked").select(F.col("host").alias("h"), F.lit(True).alias("blocked"))
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("v", verdict)
    out = rows.join(blocked, rows["host"] == blocked["h"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"))
