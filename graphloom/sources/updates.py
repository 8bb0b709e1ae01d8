"""Update batches: normalisation, insertion, deletion, duplicates, and comparison of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, mirrored


def flagged(batch: DataFrame, edges: DataFrame, order: str = "row") -> DataFrame:
    """batch(src, dst, <order>) with duplicate: repeated in the batch (all but the first row) or already in edges."""
    again = F.row_number().over(Window.partitionBy("src", "dst").orderBy(order)) > 1
    present = edges.select("src", "dst").distinct().withColumn("present", F.lit(True))
    out = batch.withColumn("again", again).join(present, ["src", "dst"], "left")
    return out.select(*batch.columns, (F.col("again") | F.coalesce("present", F.lit(False))).alias("duplicate"))


def new_edges(batch: DataFrame, edges: DataFrame, undirected: bool = True) -> DataFrame:
    """The edges a batch really adds: no loops, each once (in both directions if undirected), none that is there."""
    rows = batch.select("src", "dst").where("src <> dst")
    rows = mirrored(rows) if undirected else rows
    return rows.distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def gone_edges(batch: DataFrame, edges: DataFrame, undirected: bool = True) -> DataFrame:
    """The edges a batch really removes."""
    rows = batch.select("src", "dst")
    rows = mirrored(rows) if undirected else rows
    return edges.select("src", "dst").distinct().join(rows.distinct(), ["src", "dst"], "left_semi")


def insert(graph: Graph, batch: DataFrame) -> Graph:
    fresh = new_edges(batch, graph.edges, not graph.directed)
    ends = fresh.select(F.col("src").alias("id")).unionByName(fresh.select(F.col("dst").alias("id"))).distinct()
    vertices = graph.vertices.unionByName(ends.join(graph.vertices, "id", "left_anti"))
    return Graph(vertices, graph.edges.select("src", "dst").unionByName(fresh), graph.directed)


def delete(graph: Graph, batch: DataFrame) -> Graph:
    rows = batch.select("src", "dst") if graph.directed else mirrored(batch.select("src", "dst"))
    return Graph(graph.vertices, graph.edges.join(rows.distinct(), ["src", "dst"], "left_anti"), graph.directed)


def sorted_batch(batch: DataFrame) -> DataFrame:
    return batch.orderBy("src", "dst")


def differences(left: Graph, right: Graph) -> DataFrame:
    """(src, dst, side): edges that only one graph has, as multisets; empty if they are equal."""
    a, b = left.edges.select("src", "dst"), right.edges.select("src", "dst")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
