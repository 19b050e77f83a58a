"""Connected components over an edge table, as alternating large-star and small-star rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ROWS_A_TASK, cut


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """For each node of directed pairs (n, v): its smallest neighbour, itself included."""
    return pairs.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("n"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    pairs = _both(edges)
    least = _least_neighbour(pairs)
    return pairs.where("v > n").join(least, "n").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("v"))
    least = down.groupBy("n").agg(F.min("v").alias("m"))
    tied = down.join(least, "n").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an undirected edge table, the smallest node it reaches.

    Self loops, repeated edges and null ends are ignored; an empty edge table gives an empty result. Nodes without an edge
    are not in the result. The rounds run until the edges are stars around their roots; the number of rounds grows with the
    logarithm of a component's size. Each round ends in a reliable checkpoint, so a lost executor costs one round at most.
    """
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now, mark = cut(now), None
    n = now.count()
    if not n:
        return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    # Few edges go through few tasks in every round: a round never has more edges than twice those that are given.
    few = lambda df: df.coalesce(max(1, math.ceil(n / ROWS_A_TASK)))
    now = few(now)
    while True:
        now = few(cut(few(_small_star(few(_large_star(now))))))
        # A star forest is a fixed point of both steps: same edges as the round before.
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row.n, row.h):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        mark = (row.n, row.h)
