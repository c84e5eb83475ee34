"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v; the smallest neighbour of a node takes over the node's other neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:  # written, so that the join deals its rows anew: a node with very many neighbours is then split over tasks
        least = write_table(least, "least")
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): longs, null-free, any direction, loops and repeats allowed. Returns (node, root) for every
    node that has an edge to another one; root is the smallest node reachable and is itself a row.

    Rounds go on until one changes nothing (their number grows with the logarithm of the longest path, squared at
    worst). Every round is written to the shared folder, so a lost executor costs one round at most."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = write_table(e, "edges")
    before, after = None, _digest(e)
    while after[0] and after != before:
        before = after
        e = write_table(_star(write_table(_star(e, True), "edges"), False), "edges")
        after = _digest(e)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(out.select(F.col("root").alias("node"), "root").distinct())
