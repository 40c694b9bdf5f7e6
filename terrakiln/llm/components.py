"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakiln.llm.common import attach, checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: each node's neighbours (the larger ones, or the smaller ones and itself) take its least neighbour."""
    if large:
        edges = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpointed(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")))
    met = attach(edges, least, ["a"], "n")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (long columns a, b); the root is the component's least node.

    Alternating large and small stars until nothing changes, each round written to the checkpoint folder;
    only counts and a checksum come to the driver. A hot centre's edges are dealt over several tasks. No edge, no row.
    """
    now = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        sums = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sums == seen or not sums[0]:
            break
        seen = sums
        now = checkpointed(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
