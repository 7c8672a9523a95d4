"""Connected components by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node are linked to the least node around it; else the node and its neighbours below it are."""
    near = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    hung = near.join(least, "a")
    above = hung.where("b > a") if large else hung.where("b != least")
    out = above.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (its least id) of every node that has a link; `links` has two columns of ids, in either order.

    Links to null or to itself count for nothing; no links give no rows. Rounds go on until one changes nothing.
    """
    a, b = links.columns[:2]
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = state
        edges = written(_star(_star(edges, True), False), "edges")
