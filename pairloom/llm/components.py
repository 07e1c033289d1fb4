"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    joined = edges.join(least, "u")
    moved = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return least.select("u", F.col("low").alias("v")).unionByName(moved).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, label): the smallest node reachable; only nodes with an edge appear.

    Each round is an aggregate and a join on a node, so that a hub is combined map-side and its rows can be split; no
    neighbour list is ever gathered. Rounds are written tables, so a lost executor costs one round at most. The loop ends when a round
    changes nothing; the number of rounds grows with the logarithm of the longest chain. Null ends and loops are left out.
    """
    edges = cut_lineage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = tuple(state)
        edges = cut_lineage(_small_star(_large_star(edges)), "edges")
