"""Breadth-first search: top-down, bottom-up and hybrid. All give (id, level) of the vertices that are reached.

Each level is one job: its new vertices are checkpointed and the visited set is the union of the levels, folded into
one table every FOLD levels, so a level writes only what is new and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import small as kernels
from graphloom.session import checkpoint, checkpoint_measured, small

ALPHA, BETA = 15, 18
FOLD = 8
UNREACHED = 2147483647


def _top_down(edges: DataFrame, frontier: DataFrame, visited: DataFrame, size: int, seen: int) -> DataFrame:
    front = small(frontier.select(F.col("id").alias("src")), size)
    reached = edges.join(front, "src").select(F.col("dst").alias("id")).distinct()
    return reached.join(small(visited.select("id"), seen), "id", "left_anti")


def _bottom_up(edges: DataFrame, frontier: DataFrame, visited: DataFrame, size: int, seen: int) -> DataFrame:
    """From the side of the unvisited: their in-edges whose source is in the frontier."""
    open_ = edges.join(small(visited.select(F.col("id").alias("dst")), seen), "dst", "left_anti")
    front = small(frontier.select(F.col("id").alias("src")), size)
    return open_.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


class _Switch:
    """The hybrid's choice of direction: from the edges the frontier would check, the edges left and its size."""

    def __init__(self, graph: Graph, alpha: int, beta: int):
        self.degrees = graph.out_degrees().persist()
        self.left = graph.edges.count()
        self.vertices, self.alpha, self.beta = graph.vertices.count(), alpha, beta
        self.up, self.done, self.awake = False, False, 0

    def choose(self, frontier: DataFrame, awake: int):
        if not self.done:
            scout = small(frontier, awake).join(self.degrees, "id").agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
            if not self.up:
                self.up = scout >= self.left / self.alpha
                self.left -= scout
            elif not (awake >= self.awake or awake > self.vertices / self.beta):
                self.up, self.done = False, True  # top-down to the end
        self.awake = awake
        return _bottom_up if self.up else _top_down


def bfs(graph: Graph, root: int, strategy: str = "auto", alpha: int = ALPHA, beta: int = BETA) -> DataFrame:
    """(id, level) of all vertices reachable from root; level 0 is root. strategy: top_down, bottom_up, hybrid, or auto:
    one task where the edges were counted to be few, else hybrid."""
    if strategy == "auto":
        if kernels.is_small(graph.edges):
            known = graph.vertices.where(F.col("id") == F.lit(root)).limit(1).count()
            return kernels.search(graph.edges if known else graph.edges.limit(0), root).where(F.lit(bool(known)))
        strategy = "hybrid"
    step = {"top_down": _top_down, "bottom_up": _bottom_up, "hybrid": None}[strategy]
    spark = graph.edges.sparkSession
    edges = graph.by_source()
    switch = _Switch(graph, alpha, beta) if step is None else None
    frontier = graph.vertices.where(F.col("id") == F.lit(root)).limit(1).select("id", F.lit(0).alias("level"))
    frontier = checkpoint(frontier)
    size = frontier.count()
    if not size:
        edges.unpersist()
        return spark.createDataFrame([], "id long, level int")
    levels, level, reached = [frontier], 0, size
    while size:
        visited = levels[0]
        for x in levels[1:]:
            visited = visited.unionByName(x)
        if len(levels) >= FOLD:
            visited = checkpoint(visited)
            levels = [visited]
        level += 1
        work = step or switch.choose(frontier, size)
        found = work(edges, frontier, visited, size, reached).select("id", F.lit(level).alias("level"))
        frontier, seen = checkpoint_measured(found, size=F.count(F.lit(1)))
        size = seen["size"]
        reached += size
        levels.append(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    edges.unpersist()
    if switch:
        switch.degrees.unpersist()
    return out


def level_count(levels: DataFrame) -> DataFrame:
    """(levels, reached): depth + 1, as the last expansion finds nothing, and the vertices reached with the root."""
    return levels.agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("levels"), F.count(F.lit(1)).alias("reached"))


def with_unreached(graph: Graph, levels: DataFrame, value: int | None = None) -> DataFrame:
    """The whole universe; level is null (or value) where not reached."""
    out = graph.vertices.join(levels, "id", "left")
    return out if value is None else out.select("id", F.coalesce("level", F.lit(value)).alias("level"))
