"""Connected components by alternating large-star and small-star.

Edges are rows ``(u, v)``; each round is a grouped minimum joined back to the
edges (both sides written tables, so that Spark may split the rows of a hub)
and is written to the shared folder: a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)`` but the roots: the
    smallest node of its component.  Loops, repeated and turned edges do no
    harm; an empty table gives an empty one."""
    now = materialize(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        if state[0] == 0:
            break
        large = materialize(_large_star(now).distinct(), "large-star-edges")
        now = materialize(_small_star(large).distinct(), "small-star-edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
