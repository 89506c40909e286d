"""Connected components of an edge table, by alternating large-star and small-star steps.

The published scheme (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each
step is a minimum for each node and a join back, so no node's neighbours are ever held together,
and the rounds grow with the logarithm of the graph. Nothing but a count and a checksum reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _star(links: DataFrame) -> DataFrame:
    """links (u, v) with the least of u and all its v as m."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least, "u").withColumn("m", F.least("u", "least"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """edges (a, b) of longs: one row (node, component) for each node of an edge but the least of its component.

    Rounds end when nothing changes; a graph that still changes after ``max_rounds`` raises.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars = _star(down)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, scratch.table(small, "edges")
        scratch.drop(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return scratch.only(now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "components")
        seen = state
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of a graph whose components without ``links`` (a, b) are ``found`` (node, component).

    Only what the links join is worked on: each component is one node.
    """
    scratch = Scratch(found.sparkSession)
    ends = links
    for end in ("a", "b"):
        at = found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(at, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    joined = scratch.table(ends.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "joined")
    if joined.isEmpty():
        return found
    top = components(joined)
    above = top.select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = found.join(above, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return scratch.only(moved.unionByName(top), "components")
