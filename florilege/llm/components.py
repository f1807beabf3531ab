"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the smallest node reachable) of every node of edges (a, b): large-star and small-star steps until nothing changes.

    Each step is two aggregations with partial sums and a join on a node; every
    round is written to the shared folder, the one before it is deleted then, and only
    counts reach the driver.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, path = stored(both.distinct(), "edges")
    known = _fingerprint(state)
    for _ in range(rounds):
        # Large star: neighbours above a node go to the smallest of it and its neighbours.
        around = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: what lies below a node goes to the smallest of it.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new, new_path = stored(small, "edges")
        forget(edges.sparkSession, path)
        before, known, state, path = known, _fingerprint(new), new, new_path
        if known == before:
            break
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    labels = state.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
