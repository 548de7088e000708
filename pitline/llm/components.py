"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.session import stage

#: A loop guard: the steps need a number of rounds that grows with the logarithm of the vertices.
MAX_ROUNDS = 60


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest vertex of u's neighbourhood."""
    both = _directed(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges(u, v)``; component is the smallest vertex reachable.

    Self-loops and repeated edges change nothing; edges with a null end are ignored; no edges give no rows. The work of a
    round is joins and map-side combined minima over the edges left; each round is written to the shared folder. A vertex
    with very many edges is reduced before the shuffle, and the join that spreads its minimum is one AQE can split.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = stage(_small_star(_large_star(now)))
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            stars = now.groupBy("u").agg(F.min("v").alias("component"))
            roots = now.select("v").distinct().select(F.col("v").alias("vertex"), F.col("v").alias("component"))
            return stars.select(F.col("u").alias("vertex"), "component").unionByName(roots)
        mark = (row["n"], row["h"])
    raise RuntimeError("components did not settle")
