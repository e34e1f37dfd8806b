"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of each node's component; only nodes with an edge to another appear.

    edges: (u bigint, v bigint), undirected, repeats and loops allowed. Every step costs as many rows as there are edges
    and is written to the shared folder; the number of steps grows with the logarithm of the longest path. Stars need no
    gathering: a node's least neighbour is an aggregate, joined back.
    """
    edges = written(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = None
    while True:
        after = written(_small_star(_large_star(edges)), "cc")
        # a fixed point is a forest of stars; sums of hashes tell two edge sets apart
        found = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(edges)
        edges = after
        if state == found:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
        state = found
