"""Argument graphs: nodes, support relations (child, parent) and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch


def top_ancestors(edges: DataFrame, nodes: DataFrame, limit: int = 64) -> DataFrame:
    """node, top, depth: the root above each node (itself for a root), by pointer doubling.

    ``edges``: (child, parent), one parent each.  Rounds grow with the logarithm of the depth; a cycle
    raises.
    """
    up = nodes.select("node").join(edges.select(F.col("child").alias("node"), "parent"), "node", "left")
    cur = scratch(up.select("node", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "graph")
    for _ in range(limit):
        above = cur.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        new = scratch(cur.join(above, "top", "left").select("node", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce(F.col("next") != F.col("top"), F.lit(False)).alias("moved")), "graph")
        drop_scratch(cur)
        cur = new.drop("moved")
        cur._rostrum_path = new._rostrum_path
        if new.where("moved").isEmpty():
            break
    # What settled on a node that has a parent itself went round in a cycle.
    if cur.join(edges.select(F.col("child").alias("top")), "top", "left_semi").isEmpty():
        return cur
    raise ValueError("the support relations hold a cycle")


def check_conflicts(conflicts: DataFrame, stance: DataFrame) -> DataFrame:
    """Conflicts (id, a, b) that break a rule, with the reason: unknown node or equal stances."""
    s = stance.select("node", "stance")
    j = conflicts.join(s.toDF("a", "sa"), "a", "left").join(s.toDF("b", "sb"), "b", "left")
    why = F.when(F.col("sa").isNull() | F.col("sb").isNull(), "unknown node").when(F.col("sa") == F.col("sb"), "equal stances")
    return j.withColumn("reason", why).where("reason IS NOT NULL").select("id", "a", "b", "reason")


def bands(conflicts: DataFrame, tops: DataFrame) -> DataFrame:
    """One band per conflict in order: top argument per side, node where it is claimed first, else a reference.

    Within a band the pro side is settled before the contra side.
    """
    t = tops.select("node", "top")
    b = conflicts.join(t.toDF("a", "pro_top"), "a").join(t.toDF("b", "contra_top"), "b")
    sides = b.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("pro_top").alias("top")), F.struct(F.lit(1).alias("side"), F.col("contra_top").alias("top")))).alias("s")).select("id", "s.*")
    first = F.row_number().over(Window.partitionBy("top").orderBy("id", "side")) == 1
    return sides.select(F.col("id").alias("band"), F.when(F.col("side") == 0, "pro").otherwise("contra").alias("side"), "top", F.when(first, "node").otherwise("reference").alias("kind"))


def loose(nodes: DataFrame, tops: DataFrame, band: DataFrame) -> DataFrame:
    """Nodes whose top argument is in no band."""
    return nodes.join(tops, "node").join(band.select("top").distinct(), "top", "left_anti").select("node", "top")


def keep_relations(relations: DataFrame, checks: DataFrame, threshold: float) -> DataFrame:
    """Relations with a check of enough strength (legacy yes/no counts 1/0); a check's scheme replaces theirs."""
    c = checks.select("relation", F.coalesce("strength", F.col("legacy").cast("double")).alias("s"), F.col("scheme").alias("new_scheme"))
    return relations.join(c, "relation").where(F.col("s") >= threshold).withColumn("scheme", F.coalesce("new_scheme", "scheme")).drop("new_scheme", "s")


def list_entries(band: DataFrame, edges: DataFrame, loose_nodes: DataFrame) -> DataFrame:
    """scope, side, place, id, kind, ref_band: what the list of a side and scope shows, one row an entry.

    ``band`` as of :func:`bands`; ``loose_nodes``: node, side.  A band's scope is its id: its argument at place 0, the arguments that support it
    directly behind it (kind ``kid``, in order of id), or, where the argument belongs to an earlier band, one ``ref`` to that.  Arguments outside all
    bands have a null scope and no place.  All scopes together are the list of everything.
    """
    own = band.where("kind = 'node'")
    heads = own.select(F.col("band").alias("scope"), "side", F.lit(0).alias("place"), F.col("top").alias("id"), F.lit("node").alias("kind"), F.lit(None).cast(dict(band.dtypes)["band"]).alias("ref_band"))
    kid = own.join(edges, own["top"] == edges["parent"]).withColumn("place", F.row_number().over(Window.partitionBy("top").orderBy("child")))
    kids = kid.select(F.col("band").alias("scope"), "side", "place", F.col("child").alias("id"), F.lit("kid").alias("kind"), F.lit(None).alias("ref_band"))
    home = own.select("top", F.col("band").alias("ref_band"))
    refs = band.where("kind = 'reference'").join(home, "top").select(F.col("band").alias("scope"), "side", F.lit(0).alias("place"), F.col("top").alias("id"), F.lit("ref").alias("kind"), "ref_band")
    rest = loose_nodes.select(F.lit(None).alias("scope"), "side", F.lit(None).alias("place"), F.col("node").alias("id"), F.lit("node").alias("kind"), F.lit(None).alias("ref_band"))
    return heads.unionByName(kids).unionByName(refs).unionByName(rest)


def opposition_partners(conflicts: DataFrame) -> DataFrame:
    """node, partners: for each argument those it stands against, in either direction, sorted and each once."""
    both = conflicts.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(conflicts.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("partners"))
