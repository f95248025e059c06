"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014).

Links stay distributed: every round is two aggregations and joins, written to the shared folder. A node with very many
links is summed map-side first, and the joins back are plain equi-joins that adaptive execution splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
    return tuple(row)


def _prepared(links: DataFrame, a: str, b: str) -> DataFrame:
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    return stage(edges.distinct(), "cc")


def _round(edges: DataFrame) -> DataFrame:
    """A large and a small star: links (u, v) of larger to smaller nodes that connect the same, nearer to the smallest."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return stage(small.distinct(), "cc")


def contracted(links: DataFrame, a: str, b: str, rounds: int) -> DataFrame:
    """Links (u, v), u > v, that connect the same as ``links``, after some rounds: a node's least v is connected to it,
    if not yet the smallest that is."""
    edges = _prepared(links, a, b)
    for _ in range(rounds):
        edges = _round(edges)
    return edges


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, label) for every node that some link touches; label is the smallest node that it reaches.

    Links with a null end or to the node itself are ignored. Rounds grow with the logarithm of the longest path;
    ``max_rounds`` is a guard that raises, it never cuts work short.
    """
    edges = _prepared(links, a, b)
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = _round(edges)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
