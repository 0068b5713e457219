"""Connected components by alternating star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .workspace import Workspace


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def connected_components(edges: DataFrame, space: Workspace, name: str = "edges", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one ordered type); root is the least node reachable.

    Each round links the neighbours of every node to the least of them, first
    the larger neighbours, then the smaller ones; the depth of the trees falls
    by a constant factor a round, and the loop ends when the edges form stars.
    Minima are combined before each shuffle, and in the joins that follow the
    edges of a hub are dealt by their other ends.
    """
    now = space.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-0")
    seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    for i in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both).select("u", F.least("u", "m").alias("m"), "n")
        large = join_unique(both, near, ["u"], "n", 2 * seen[0], F.col("v")).filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = join_unique(large, _least(large), ["u"], "n", seen[0], F.col("v"))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = space.keep(small, f"{name}-{i}")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
