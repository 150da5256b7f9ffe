"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact


def _with_least(edges: DataFrame) -> DataFrame:
    """Rows (u, v) with ``m``, the least of u and its neighbours v.

    The least ones are summed up in part in every task and written as a table of one row per node, so that the
    join has two plain sides and adaptive execution can split a node of very many edges."""
    least, _ = compact(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return edges.join(least, "u")


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Nothing is gathered; each step is checkpointed in as many parts as its edges need. The loop ends
    when a round changes no edge, after about log2 of the longest path."""
    now, _ = compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = compact(_with_least(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now, _ = compact(small)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
