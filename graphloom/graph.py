"""Graph: a vertex DataFrame (id) and an edge DataFrame (src, dst), both of 64-bit ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def mirrored(edges: DataFrame) -> DataFrame:
    """edges and their reverses, repeats kept."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@dataclass(frozen=True)
class Graph:
    """vertices(id) is the universe (endpoints of edges, if not given); edges(src, dst) hold one row per direction.

    pairs(src, dst), where known: each edge of a simple symmetric graph once, src < dst.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    pairs: DataFrame | None = None

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False) -> Graph:
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        return Graph(vertices.select(F.col("id").cast("long").alias("id")), edges, directed)

    @staticmethod
    def from_pairs(pairs: DataFrame) -> Graph:
        """A simple symmetric graph from each of its edges once, src < dst, without repeats."""
        graph = Graph.from_edges(mirrored(pairs))
        return Graph(graph.vertices, graph.edges, False, pairs)

    @staticmethod
    def from_csr(spark: SparkSession, offsets: list[int], adjacency: list[int], directed: bool = False) -> Graph:
        """A graph from compressed rows: the out-edges of v are adjacency[offsets[v]:offsets[v + 1]]. For lists on the
        driver; tables of any size go through from_csr_tables."""
        off = spark.createDataFrame(list(enumerate(offsets)), "id long, offset long")
        adj = spark.createDataFrame(list(enumerate(adjacency)), "at long, dst long")
        return Graph.from_csr_tables(off, adj, directed)

    @staticmethod
    def from_csr_tables(offsets: DataFrame, adjacency: DataFrame, directed: bool = False) -> Graph:
        """The same from offsets(id, offset), the last of which ends the last row, and adjacency(at, dst)."""
        ends = offsets.select((F.col("id") - 1).alias("id"), F.col("offset").alias("end"))
        rows = offsets.join(ends, "id")
        places = rows.where("end > offset").select(F.col("id").alias("src"), F.explode(F.sequence("offset", F.col("end") - 1)).alias("at"))
        return Graph.from_edges(places.join(adjacency, "at").select("src", "dst"), rows.select("id"), directed)

    def with_universe(self, vertices: DataFrame) -> Graph:
        return Graph.from_edges(self.edges, vertices, self.directed)

    def simple(self) -> Graph:
        """Without loops and repeated edges."""
        return Graph(self.vertices, self.edges.where("src <> dst").distinct(), self.directed)

    def symmetrize(self) -> Graph:
        return Graph(self.vertices, mirrored(self.edges).distinct(), False)

    def transpose(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.directed)

    def out_degrees(self) -> DataFrame:
        """(id, degree) of vertices with an out-edge."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    def degrees(self) -> DataFrame:
        """(id, degree) of the whole universe."""
        return self.vertices.join(self.out_degrees(), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def nonzero_vertices(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("src").alias("id")), "id", "left_semi")

    def max_degree_vertex(self) -> DataFrame:
        """One row (id, degree): the largest out-degree, lowest id."""
        return self.degrees().orderBy(F.desc("degree"), "id").limit(1)

    def degree_histogram(self) -> DataFrame:
        return self.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))

    def adjacency(self) -> DataFrame:
        """(id, neighbours): sorted arrays; for graphs whose degrees are moderate."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))

    def edge_count(self) -> DataFrame:
        return self.edges.agg(F.count(F.lit(1)).alias("edges"))

    def by_source(self) -> DataFrame:
        """Edges dealt by src and kept, for loops that join them on src again and again. Call unpersist when done."""
        return self.edges.select("src", "dst").repartition("src").persist()
