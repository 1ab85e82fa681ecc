"""Connected components by alternating large-star and small-star steps, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return _down(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    own = least.select(F.col("a").alias("x"), F.col("m").alias("y"))
    return _down(moved.unionByName(own))


def _down(pairs: DataFrame) -> DataFrame:
    """Edges from the larger end to the smaller, once each."""
    return pairs.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every end of an edge; the component is its smallest node.

    Edges with a null end and loops say nothing and are left out; an empty frame gives an empty one.
    Each round's edges are written to the shared folder; only one sum and one count reach the driver."""
    now = stored(_down(edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null")), "edges")
    seen = None
    for _ in range(rounds):
        before, now = now, stored(_small_star(_large_star(now)), "edges")
        released(before)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            tops = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
