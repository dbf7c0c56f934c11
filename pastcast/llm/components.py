"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to the smallest node it knows, and keeps components as
they are; after few rounds every node points at its component's smallest node. Both steps are an
aggregate and a join on the node. A node with very many edges is combined before the shuffle, and its
edges stay where they are: of nodes with more than one in HEAVY of all edges there are fewer than HEAVY, so what they
meet is broadcast. Nothing is gathered on the driver but a few sums.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What is broadcast in a step has fewer rows.
HEAVY = 1024


def _state(edges: DataFrame) -> tuple:
    # Wrapping sums of hashes: a change of the edge set shows.
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def _meet(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with ``m`` of ``least`` (u, m, n): the edges of nodes with very many are not shuffled."""
    heavy = F.broadcast(least.filter(F.col("n") * HEAVY > total).select("u", F.col("m").alias("heavy_m")))  # fewer than HEAVY rows
    marked = edges.join(heavy, "u", "left")
    light = marked.filter("heavy_m IS NULL").drop("heavy_m").join(least.filter(F.col("n") * HEAVY <= total).select("u", "m"), "u")
    return light.select("u", "v", "m").union(marked.filter("heavy_m IS NOT NULL").select("u", "v", "heavy_m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return (_meet(both, least, 2 * total).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _meet(down, least, total).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node.

    Edges from a node to itself and repeated edges change nothing; nulls must be filtered out before.
    """
    at = materialise(edges.filter("u != v").select("u", "v"), "edges")
    before = _state(at)
    while before[0]:
        wide = materialise(_large_star(at, before[0]), "wide-stars")
        at = materialise(_small_star(wide, wide.count()), "stars")
        now = _state(at)
        if now == before:
            break
        before = now
    tops = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
