"""Connected components of an undirected edge list by alternating large and small stars.

Each round rewires every vertex to the least vertex around it; rounds are few (logarithmic in practice), each is two
shuffles of narrow rows, and a vertex with very many edges is combined before the shuffle. Lineage is cut with
reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint, checkpoint_measured


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """Least neighbours are cut off before they are joined: a join of two plain shuffles is one that AQE can split at a hub."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.where("v > u").join(checkpoint(_least(both)), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = checkpoint(large.where("u <> v").distinct())  # every edge now points down: v < u
    least = checkpoint(_least(large))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (u, root): every vertex with an edge to another but the roots, with the least of its component.

    Nulls and loops are ignored; a root itself has no row.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    marks = {"n": F.count(F.lit(1)), "mix": F.bit_xor(F.xxhash64("u", "v"))}
    now, state = checkpoint_measured(down, **marks)
    for _ in range(max_rounds):
        if not state["n"]:
            break
        before = state
        now, state = checkpoint_measured(_round(now), **marks)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root"))
