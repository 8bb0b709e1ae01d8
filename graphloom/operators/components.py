"""Weakly connected components; a component's label is its greatest vertex id.

baseline: labels travel one edge from the previous round, then two pointer jumps. concurrent: the label also goes
to the vertex that the old label names (its root) and one jump follows, so trees merge whole. load_balanced: the
same over vertices with edges only, each neighbourhood combined in salted parts first. delta: only labels that changed
travel. All reach the same fixpoint; the number of rounds is a measure, not a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, mirrored
from graphloom.operators import small as kernels
from graphloom.session import BROADCAST_ROWS, checkpoint, checkpoint_measured, small

SALT = 16


def _raise(state: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """state with labels raised to those of found(id, label)."""
    best = found.groupBy("id").agg(F.max("label").alias("up"))
    return state.join(small(best, n), "id", "left").select("id", F.greatest("label", "up").alias("label"))


def shortcut(state: DataFrame, n: int = BROADCAST_ROWS + 1) -> DataFrame:
    """Pointer jump: label of the label. n: rows of state, if known."""
    up = state.select(F.col("id").alias("label"), F.col("label").alias("up"))
    return state.join(small(up, n), "label").select("id", F.col("up").alias("label"))


def _from_neighbours(edges: DataFrame, state: DataFrame, n: int) -> DataFrame:
    return edges.join(small(state.select(F.col("id").alias("src"), "label"), n), "src").select(F.col("dst").alias("id"), "label")


def _to_roots(state: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """found, and the same label for the root (old label) of each vertex that it raises."""
    best = found.groupBy("id").agg(F.max("label").alias("label"))
    old = state.select("id", F.col("label").alias("root"))
    roots = best.join(small(old, n), "id").where("label > root").select(F.col("root").alias("id"), "label")
    return best.unionByName(roots)


def _salted(edges: DataFrame, state: DataFrame, n: int) -> DataFrame:
    found = _from_neighbours(edges, state, n).withColumn("salt", F.pmod(F.xxhash64("label"), F.lit(SALT)))
    return found.groupBy("id", "salt").agg(F.max("label").alias("label")).drop("salt")


def _pairs(edges: DataFrame) -> DataFrame:
    """(src, dst): the ends of each edge once, whatever its directions, src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def connected_components(graph: Graph, strategy: str = "auto", max_rounds: int = 200) -> DataFrame:
    """(id, label) of the whole universe. strategy: baseline, concurrent, load_balanced, delta, or auto: one task where the
    edges, or the pairs of their ends, were counted to be few, else concurrent."""
    return components_and_rounds(graph, strategy, max_rounds)[0]


def components_and_rounds(graph: Graph, strategy: str = "auto", max_rounds: int = 200) -> tuple[DataFrame, int]:
    """(connected_components, rounds run): the last round changes nothing; 0 where one task did all."""
    if strategy == "auto":
        if kernels.is_small(graph.edges):
            found = kernels.component_labels(graph.edges).withColumnRenamed("label", "found")
            return graph.vertices.join(found, "id", "left").select("id", F.coalesce("found", "id").alias("label")), 0
        strategy = "concurrent"
        pairs, seen = checkpoint_measured(_pairs(graph.edges), n=F.count(F.lit(1)))
        if seen["n"] <= kernels.LOCAL_EDGES:  # half as many as the edges of a symmetric graph
            found = kernels.component_labels(pairs).withColumnRenamed("label", "found")
            return graph.vertices.join(found, "id", "left").select("id", F.coalesce("found", "id").alias("label")), 0
        edges = mirrored(pairs).repartition("src").persist()
    else:
        edges = mirrored(graph.edges.where("src <> dst")).distinct().repartition("src").persist()
    every = graph.vertices.select("id", F.col("id").alias("label"))
    if strategy == "load_balanced":
        state = edges.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"))
    else:
        state = every
    state, seen = checkpoint_measured(state, n=F.count(F.lit(1)))
    changed, n = state, seen["n"]
    for rounds in range(1, max_rounds + 1):
        if strategy == "baseline":
            after = shortcut(checkpoint(shortcut(checkpoint(_raise(state, _from_neighbours(edges, state, n), n)), n)), n)
        elif strategy == "concurrent":
            after = shortcut(checkpoint(_raise(state, _to_roots(state, _from_neighbours(edges, state, n), n), n)), n)
        elif strategy == "load_balanced":
            after = shortcut(checkpoint(_raise(state, _to_roots(state, _salted(edges, state, n), n), n)), n)
        elif strategy == "delta":
            after = shortcut(checkpoint(_raise(state, _to_roots(state, _from_neighbours(edges, changed, n), n), n)), n)
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        old = state.select("id", F.col("label").alias("was"))
        both, seen = checkpoint_measured(after.join(small(old, n), "id"), changed=F.count_if(F.col("label") != F.col("was")))
        state = both.select("id", "label")
        changed = both.where("label <> was").select("id", "label")
        if not seen["changed"]:
            break
    else:
        raise RuntimeError("components did not settle")
    edges.unpersist()
    if strategy == "load_balanced":
        state = every.join(state.withColumnRenamed("label", "found"), "id", "left").select("id", F.coalesce("found", "label").alias("label"))
    return state, rounds


def component_count(graph: Graph, labels: DataFrame, singletons: bool = False) -> DataFrame:
    """(components): vertices that are their own label; without singletons, only those with an out-edge count."""
    roots = labels.where("id = label")
    if not singletons:
        roots = roots.join(graph.edges.select(F.col("src").alias("id")), "id", "left_semi")
    return roots.agg(F.count(F.lit(1)).alias("components"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
