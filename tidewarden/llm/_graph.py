"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import checkpoint


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are joined to its least neighbour or itself: the larger ones, or the others and itself."""
    n = _both(e)
    if not large:
        n = n.where("v < u")
    m = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = n.join(m, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, *spent: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (u, v); a component's name is its least node.

    Nulls are left out; loops and repeated edges don't matter; without edges
    there is no row.  A hub's neighbours are never gathered: stars are an
    aggregation and a join, which adaptive execution can split.  Rounds go on
    until nothing changes, about as many as the logarithm of the longest path.
    ``spent`` checkpoints go once the edges are written.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *spent)
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, after = None, sign(e)
    while after[0] and after != before:
        before = after
        e = checkpoint(_stars(_stars(e, True), False), e)
        after = sign(e)
    return checkpoint(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), e)
