"""Connected components of a graph given as a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked id with the smallest id that it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each replaces links by links to the smallest
    neighbour, which takes a number of rounds that grows with the logarithm of a component's size, whatever its shape.
    Every step is an aggregation with partial sums and an equi-join; the links of a star's centre, two numbers each, meet in
    one task. A round that changes nothing ends it; what the rounds hold is told apart by their number of links and two 64-bit sums. Empty input gives no rows; self-links count for nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = scratch.table(edges)
    held = _sum(edges)
    while held[0]:
        small = scratch.table(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges, before, held = small, held, _sum(small)
        if held == before:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _sum(edges: DataFrame) -> tuple:
    """What tells two sets of distinct links apart, in one row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit("again")))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least of u and u's neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end) and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
