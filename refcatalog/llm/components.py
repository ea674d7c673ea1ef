"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs → (node, component), component = smallest node reachable.

    Every node of an edge gets a row; nodes without edges are the caller's.
    Self-loops, repeated and reversed edges are allowed; an empty table gives an
    empty one. Each round is two shuffles of the edge table, written to the
    shared folder; no link or component reaches the driver. A hub's edges are
    grouped by partial minima; in the two joins they are rows of 16 bytes of one
    key, which adaptive execution splits once they outgrow a partition. Rounds
    go on until only stars are left; their number grows with the square of the
    logarithm of the node count at most.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: neighbours above a node move to its smallest neighbour.
        large = both.join(low.hint("shuffle_hash"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its lower neighbours meet at the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("shuffle_hash"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a <> b").distinct())
        # Stars only: no node is both a centre and a leaf, and each leaf has one centre.
        leaves = after.select(F.col("a").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("centre"))
        centres = after.select(F.col("b").alias("node")).distinct().select("node", F.lit(0).cast("long").alias("n"), F.lit(1).alias("centre"))
        bad = leaves.unionByName(centres).groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("n > 1 or k > 1")
        done = bad.limit(1).count() == 0
        now = after
        if done:
            leaf = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaf.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
