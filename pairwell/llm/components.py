"""Connected components of links that stay distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours of each node to its smallest neighbour (itself included): the larger ones, or
    the smaller ones and itself. ``edges`` has distinct (u, v) with u < v."""
    out = edges.select(F.col("v").alias("n"), F.col("u").alias("w"))
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(out)
        roots = both.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
        pairs = both.where("w > n").join(roots, "n").select(F.col("m").alias("u"), F.col("w").alias("v"))
    else:
        roots = out.groupBy("n").agg(F.min("w").alias("m"))
        joined = out.join(roots, "n")
        pairs = joined.select(F.col("m").alias("u"), F.col("w").alias("v")).unionByName(roots.select(F.col("m").alias("u"), F.col("n").alias("v")))
    return pairs.where("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has an edge.

    ``edges`` has columns u, v (long). Each round writes its edges to the shared folder; the rounds end
    when none changes, after a number that grows with the logarithm of the longest chain.
    """
    ordered = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now, mark = written(ordered), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == mark:
            break
        mark = (state.n, state.s)
        now = written(_star(_star(now, True), False))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
