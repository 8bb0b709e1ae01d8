"""PageRank by power iteration with an L1 stop.

Only active vertices (out-degree > 0) are updated: isolated vertices score 0 by default, and the mass of dangling ones
is not dealt out again. direction "out" gathers along stored edges (each vertex from the targets of its out-edges, for
symmetric graphs), "push" sends to targets (the usual directed form).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.graph import Graph
from graphloom.session import checkpoint, checkpoint_measured, small


def page_rank(
    graph: Graph, max_iterations: int = 20, threshold: float = 0.001, damping: float = 0.85, direction: str = "out", isolated: str = "zero"
) -> tuple[DataFrame, int]:
    """((id, score) of the universe, iterations run). At least one iteration runs if max_iterations > 0."""
    nv = graph.vertices.count()
    base = (1 - damping) / nv if nv else 0.0
    fetch, give = ("dst", "src") if direction == "out" else ("src", "dst")
    edges = graph.edges.select(F.col(fetch).alias("from"), F.col(give).alias("to")).repartition("from").persist()
    state = graph.vertices.join(graph.out_degrees(), "id").select("id", "degree", F.lit(1.0 / max(1, nv)).alias("score"))
    state = checkpoint(state)
    difference, rounds = threshold + 1, 0
    while rounds < max_iterations and difference > threshold:
        shares = state.select(F.col("id").alias("from"), fn.contribution(F.col("score"), F.col("degree")).alias("share"))
        sent = edges.join(small(shares, nv), "from")
        got = sent.groupBy(F.col("to").alias("id")).agg(F.sum("share").alias("sum"))
        fresh = fn.damped(F.col("sum"), damping, max(1, nv))
        after = state.join(small(got, nv), "id", "left").select("id", "degree", fresh.alias("score"), fn.moved(fresh, F.col("score")).alias("moved"))
        after, seen = checkpoint_measured(after, moved=F.coalesce(F.sum("moved"), F.lit(0.0)))
        difference = seen["moved"]
        state, rounds = after.select("id", "degree", "score"), rounds + 1
    edges.unpersist()
    rest = 0.0 if isolated == "zero" else base
    scores = graph.vertices.join(state.select("id", "score"), "id", "left").select("id", F.coalesce("score", F.lit(rest)).alias("score"))
    return scores, rounds


def ranking(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k best, ties to the smaller id."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def total(scores: DataFrame) -> DataFrame:
    return scores.agg(F.sum("score").alias("total"))
