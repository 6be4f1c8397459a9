"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import packed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
    ).first()
    return row["n"], row["sum"]


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v. Aggregated before the join, so a node with very
    many neighbours costs one row per task in the first and is split by AQE in the second."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges(u, v)``; component is the least id it reaches.

    Alternates the two star contractions (neighbours above a node move to its least neighbour, then
    those below it) until the edges stay as they are: they then are stars around the least ids. The
    number of rounds is logarithmic in the diameter. Each round is kept in the shared folder, in partitions by
    its number of edges, so rounds over few edges do not shuffle.
    """
    edges = packed(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large.distinct())
        edges = packed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
