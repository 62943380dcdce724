"""Connected components by alternating large-star and small-star rounds, all as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import HOT_ROWS, materialize, spread_join


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One round: every node links its larger (large) or its smaller-or-equal (small) neighbours to the least node it sees. ``most``: the links of the node that has most."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b"), F.least("a", "b"))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    seen = spread_join(both, least, ["u"], "v", most)
    if large:
        return seen.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    moved = seen.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _both_stars(edges: DataFrame) -> DataFrame:
    """A large and a small round where no node has very many links: a node's links are one window, so that both rounds are three shuffles."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return small.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether some node has two links up, or one up and one down, so that the links are no stars yet, and the links of the node that has most."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("n"))
    row = found.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).alias("open"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return row["open"] > 0, row["most"]


def connected_components(edges: DataFrame, *, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Rounds go on until every node hangs on one root that hangs on nothing; each is written to the shared folder, so that lineage stays short. The number
    of rounds grows with the logarithm of the longest chain. A node with very many links is split over tasks. Self-links and repeated links are harmless; no links give no rows.
    """
    current = materialize(edges.where("a != b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), f"{name}-edges")
    while True:
        unfinished, most = _shape(current)
        if not unfinished:
            break
        # a node's links of the first half become at most as many of the second half
        if most <= HOT_ROWS:
            moved = _both_stars(current)
        else:
            moved = _star(materialize(_star(current, True, most).where("a != b").distinct(), f"{name}-large"), False, most)
        current = materialize(moved.where("a != b").distinct(), f"{name}-edges")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
