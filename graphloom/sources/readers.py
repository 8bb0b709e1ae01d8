"""Readers of graph text files (DIMACS-10, SNAP, Matrix Market) and Parquet edges, and a Parquet writer.

Text is read by Spark's own reader with whole-stage expressions. DIMACS needs line numbers: the file's lines get
consecutive numbers from the row order of one file, in two levels (lines of a partition, partitions of the file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.session import checkpoint


def _numbered(lines: DataFrame) -> DataFrame:
    """(n, value): consecutive numbers from 0 in the order of the file."""
    rows = checkpoint(lines.select("value", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the file
    parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    n = F.col("base") + F.col("at") - F.shiftleft("part", 33)
    return rows.join(F.broadcast(parts), part == F.col("part")).select(n.alias("n"), "value")


def _ids(head: DataFrame) -> DataFrame:
    """(id): 0 to nv - 1, over many partitions, from the one row head(nv)."""
    row = head.first()
    return head.sparkSession.range(row.nv if row and row.nv else 0)


def _fields(value: str = "value"):
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def read_dimacs(spark: SparkSession, path: str) -> Graph:
    """METIS-like lines: a header (vertices, edges), then line v holds the 1-based neighbours of vertex v."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    rows = _numbered(lines)
    head = rows.where("n = 0").select(F.element_at(_fields(), 1).cast("long").alias("nv"))
    body = rows.where("n > 0").select((F.col("n") - 1).alias("src"), F.explode(_fields()).alias("word")).where("word <> ''")
    edges = body.select("src", (F.col("word").cast("long") - 1).alias("dst"))
    return Graph.from_edges(edges, _ids(head))


def read_snap(spark: SparkSession, path: str, relabel: bool = False, directed: bool = True) -> Graph:
    """White-space separated pairs, # comments. relabel: ids become ranks of the ids in use."""
    f = _fields()
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    edges = lines.select(F.element_at(f, 1).cast("long").alias("src"), F.element_at(f, 2).cast("long").alias("dst"))
    if not relabel:
        return Graph.from_edges(edges, directed=directed)
    used = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    names = _numbered(used.orderBy("id").select(F.col("id").cast("string").alias("value")))
    names = names.select(F.col("value").cast("long").alias("old"), F.col("n").alias("new"))
    for end in ("src", "dst"):
        edges = edges.join(names.withColumnRenamed("old", end), end).drop(end).withColumnRenamed("new", end)
    return Graph.from_edges(edges.select("src", "dst"), names.select(F.col("new").alias("id")), directed)


def read_matrix_market(spark: SparkSession, path: str, symmetrize: bool | None = None) -> Graph:
    """Coordinate files: % lines, one line of sizes, 1-based pairs. symmetrize: mirror (by the header, if None)."""
    text = spark.read.text(path)
    if symmetrize is None:
        first = text.where(F.lower("value").startswith("%%matrixmarket")).limit(1).collect()
        symmetrize = bool(first) and "symmetric" in first[0].value.lower()
    rows = _numbered(text.where(~F.col("value").startswith("%") & (F.trim("value") != "")))
    f = _fields()
    size = rows.where("n = 0").select(F.greatest(F.element_at(f, 1).cast("long"), F.element_at(f, 2).cast("long")).alias("nv"))
    edges = rows.where("n > 0").select((F.element_at(f, 1).cast("long") - 1).alias("src"), (F.element_at(f, 2).cast("long") - 1).alias("dst"))
    graph = Graph.from_edges(edges, _ids(size), directed=not symmetrize)
    return graph.symmetrize() if symmetrize else graph


def read_parquet(spark: SparkSession, edges: str, vertices: str | None = None, directed: bool = False) -> Graph:
    return Graph.from_edges(spark.read.parquet(edges), spark.read.parquet(vertices) if vertices else None, directed)


def write_parquet(graph: Graph, edges: str, vertices: str) -> None:
    graph.edges.write.mode("overwrite").parquet(edges)
    graph.vertices.write.mode("overwrite").parquet(vertices)


def read_graph(spark: SparkSession, path: str) -> Graph:
    """By extension, anywhere in the path as the testers of such files do: .graph, .txt, .mtx, .parquet."""
    for mark, reader in ((".graph", read_dimacs), (".txt", read_snap), (".mtx", read_matrix_market), (".parquet", read_parquet)):
        if mark in path:
            return reader(spark, path)
    raise ValueError(f"unknown graph format: {path}")
