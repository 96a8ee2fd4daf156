"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Nothing of the graph comes to the driver but a count and a checksum each round. Hubs are safe: minima are combined before
the shuffle and written, so that both sides of the joins that bring them back are plain shuffles, whose heavy partitions the
adaptive planner splits. A round's tables are deleted when it is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, cut, drop_table

MAX_ROUNDS = 60


def _canonical(edges: DataFrame) -> DataFrame:
    """hi > lo, each edge once; loops and edges with a null end go."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where(F.col("hi") != F.col("lo")).distinct()


def _round(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges of the next round."""
    both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
    least = scratch.cut(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
    large = scratch.cut(edges.join(least, edges.lo == least.n).select(F.col("hi"), F.col("m").alias("lo")), "large")
    lowest = scratch.cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
    small = large.join(lowest, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return _canonical(small.unionByName(lowest.select(F.col("hi").alias("a"), F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.shiftright(F.xxhash64("hi", "lo"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have an edge: component is the smallest node reachable.

    edges: longs a and b, in any order, repeated or not. Empty edges give an empty result.
    """
    spark = edges.sparkSession
    now, path = cut(_canonical(edges), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        then, last = now, path
        with Scratch(spark) as scratch:
            now, path = cut(_round(then, scratch), "edges")
        before, state = state, _state(now)
        drop_table(spark, last)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    lows = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(lows)
