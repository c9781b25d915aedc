"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.tables import join_hot, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long); ``root`` is the smallest node of its component.

    Each round sends every node's larger neighbours to the smallest one, then
    its smaller neighbours; edges become stars around the roots after a number of
    rounds logarithmic in the size of a component. A node that a large part of all edges meet
    is joined by broadcast. Rounds are written tables, and
    all that comes to the driver is a count and a checksum. An empty list has none.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    before, state = None, _state(now)
    n_edges = state[0]
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        low = written(low, "lowest")
        large = join_hot(both, low, "u", "n", 2 * n_edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small-star")
        before, state = state, _state(now)
        n_edges = state[0]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
