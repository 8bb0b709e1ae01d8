"""Traversal operators: a user's column functions over vertices, edges, listed vertices and update batches.

A vertex function maps a state row to columns; an edge function maps a joined row, with the columns of the source's
state prefixed s_ and of the target's d_, to one column. Both build Catalyst expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph

VertexFunction = Callable[[], dict[str, Column]]
EdgeFunction = Callable[[], Column]


def map_vertices(state: DataFrame, function: VertexFunction) -> DataFrame:
    """All vertices: state with the function's columns set."""
    return state.withColumns(function())


def map_listed(state: DataFrame, ids: DataFrame, function: VertexFunction) -> DataFrame:
    """Vertices of ids(id) only; each once, however often it is listed."""
    return map_vertices(state.join(ids.select("id"), "id", "left_semi"), function)


def _side(state: DataFrame, prefix: str, key: str) -> DataFrame:
    return state.select(F.col("id").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in state.columns if c != "id"])


def edge_rows(edges: DataFrame, state: DataFrame, source: bool = True, target: bool = True) -> DataFrame:
    """Edges with the state of their ends. Ask only for the ends that are read: each is a join."""
    if source:
        edges = edges.join(_side(state, "s_", "src"), "src")
    return edges.join(_side(state, "d_", "dst"), "dst") if target else edges


def gather(
    edges: DataFrame, state: DataFrame, function: EdgeFunction, at: str = "src", aggregate=F.sum, source: bool = True, target: bool = True
) -> DataFrame:
    """(id, value): the function over all edges, aggregated at one end (src or dst). Combined before the shuffle."""
    rows = edge_rows(edges, state, source, target).select(F.col(at).alias("id"), function().alias("value"))
    return rows.groupBy("id").agg(aggregate("value").alias("value"))


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-edges of the vertices of frontier(id), once for each time a vertex is listed."""
    return edges.join(frontier.select(F.col("id").alias("src")), "src")


def expand_once(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-edges of the vertices of frontier(id), each edge once."""
    return edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")


def batch_edges(batch: DataFrame, state: DataFrame, function: EdgeFunction, source: bool = True, target: bool = True) -> DataFrame:
    """The function over every row of an update batch, repeats included: src, dst, value."""
    return edge_rows(batch.select("src", "dst"), state, source, target).select("src", "dst", function().alias("value"))


def vertex_state(graph: Graph, **columns: Column) -> DataFrame:
    return graph.vertices.select("id", *[c.alias(n) for n, c in columns.items()])
