"""Katz centrality with bounds and top-K pruning, and its maintenance under edge batches.

With M the greatest out-degree, alpha = 1 / (M + 1) and c_i(v) = alpha^i * (walks of length i leaving v), the scores are
the sums of c_i and the bounds are score + c_i / M below and score + c_i above. Carrying c_i instead of walk counts
keeps everything in doubles at any length; exact counts are offered apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.session import checkpoint, small


@dataclass
class Katz:
    """state(id, kc, lower, upper, active); iteration: rounds run + 1; history[i](id, c): c_i, from c_0 = 1 on."""

    state: DataFrame
    iteration: int
    alpha: float
    history: list[DataFrame]

    def scores(self) -> DataFrame:
        return self.state.select("id", "kc")

    def top(self, k: int) -> DataFrame:
        return self.state.where("active").orderBy(F.desc("lower"), "id").limit(k)


def _walk(edges: DataFrame, c: DataFrame, alpha: float) -> DataFrame:
    """(id, c): alpha times the sum of c over the targets of each vertex's out-edges; vertices without one are absent."""
    sent = edges.join(c.select(F.col("id").alias("dst"), "c"), "dst")
    return sent.groupBy(F.col("src").alias("id")).agg((F.sum("c") * F.lit(alpha)).alias("c"))


def max_degree(graph: Graph) -> int:
    return graph.out_degrees().agg(F.coalesce(F.max("degree"), F.lit(0))).first()[0]


def katz(graph: Graph, max_iterations: int = 20, k: int = 100, top_degree: int | None = None, keep_history: bool = False) -> Katz:
    """Rounds run while more than k vertices are active, at most max_iterations - 1 of them; k = 0: nothing is pruned."""
    if max_iterations < 1:
        raise ValueError("max_iterations must be at least 1")
    m = max_degree(graph) if top_degree is None else top_degree
    alpha = 1.0 / (m + 1)
    edges = graph.edges.select("src", "dst").repartition("dst").persist()
    state = graph.vertices.select("id", F.lit(1.0).alias("c"), *[F.lit(0.0).alias(x) for x in ("kc", "lower", "upper")], F.lit(True).alias("active"))
    state = checkpoint(state)
    history = [state.select("id", "c")]
    active, iteration = state.count(), 1
    n = active
    while active > k and iteration < max_iterations:
        walked = _walk(edges, state.select("id", "c"), alpha).withColumnRenamed("c", "next")
        c = F.coalesce("next", F.lit(0.0))
        kc = F.col("kc") + c
        state = state.join(small(walked, n), "id", "left").select("id", c.alias("c"), kc.alias("kc"), (kc + c / F.lit(float(max(1, m)))).alias("lower"), (kc + c).alias("upper"), "active")
        state = checkpoint(state)
        if k > 0:
            best = state.where("active").orderBy(F.desc("lower")).limit(k).agg(F.min("lower")).first()[0]
            state = state.withColumn("active", F.col("active") & (F.col("upper") > F.lit(best)))
            active = state.where("active").count()
        if keep_history:
            history.append(state.select("id", "c"))
        iteration += 1
    edges.unpersist()
    return Katz(state.drop("c"), iteration, alpha, history)


def walk_counts(graph: Graph, length: int) -> DataFrame:
    """(it, id, n): exact numbers of walks of each length up to `length` that leave each vertex, as decimal(38, 0)."""
    edges = graph.edges.select("src", "dst").repartition("dst").persist()
    n = checkpoint(graph.vertices.select("id", F.lit(1).cast("decimal(38,0)").alias("n")))
    out = n.select(F.lit(0).alias("it"), "id", "n")
    for i in range(1, length + 1):
        sent = edges.join(n.select(F.col("id").alias("dst"), "n"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("n").cast("decimal(38,0)").alias("s"))
        n = graph.vertices.join(sent, "id", "left").select("id", F.coalesce("s", F.lit(0)).cast("decimal(38,0)").alias("n"))
        n = checkpoint(n)
        out = out.unionByName(n.select(F.lit(i).alias("it"), "id", "n"))
    edges.unpersist()
    return out


def fixed_rounds(graph: Graph, rounds: int, alpha: float) -> list[DataFrame]:
    """History c_0 .. c_rounds without pruning."""
    return katz(graph, rounds + 1, 0, round(1 / alpha) - 1, keep_history=True).history


def update(history: list[DataFrame], after: Graph, batch: DataFrame, sign: int, alpha: float) -> list[DataFrame]:
    """History on the graph `after` a batch went in (sign 1) or out (sign -1); alpha stays.

    batch(src, dst): only edges that really changed, each once. The change of c_i comes from two sides: changes of c_{i-1} over the
    edges that are there now, and old c_{i-1} over the batch. Only vertices with a change are touched.
    """
    edges = after.edges.select("src", "dst").repartition("dst").persist()
    batch = batch.select("src", "dst").persist()
    out, delta = [checkpoint(history[0])], None  # new vertices were added to it: its plan must not grow from batch to batch
    for i in range(1, len(history)):
        moved = _walk(batch, history[i - 1], alpha * sign)
        if delta is not None:
            moved = moved.unionByName(_walk(edges, delta, alpha))
        delta = checkpoint(moved.groupBy("id").agg(F.sum("c").alias("c")))
        change = delta.withColumnRenamed("c", "by")
        out.append(checkpoint(history[i].join(change, "id", "left").select("id", (F.col("c") + F.coalesce("by", F.lit(0.0))).alias("c"))))
    edges.unpersist()
    batch.unpersist()
    return out


def scores_of(history: list[DataFrame]) -> DataFrame:
    """(id, kc): the sum of c_1, c_2, ..."""
    rows = history[0].select("id", F.lit(0.0).alias("c"))
    for c in history[1:]:
        rows = rows.unionByName(c.select("id", "c"))
    return rows.groupBy("id").agg(F.sum("c").alias("kc"))
