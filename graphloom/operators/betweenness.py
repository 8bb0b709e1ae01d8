"""Betweenness centrality by Brandes' accumulation from many roots at once.

A graph counted to be small is broadcast, and tasks take groups of roots (operators.small). Beyond, paths never leave a
component, so components are dealt to tasks, in parts of their roots: state stays in the tasks. Only components that
are too large for a task go by joins, with state keyed by (root, id); roots go in blocks whose state, a row per vertex and
root at most, stays at about STATE rows. Scores are not
normalised and not halved; sampled roots are not rescaled unless asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import small as kernels
from graphloom.operators.components import connected_components
from graphloom.session import checkpoint, checkpoint_measured, small
from graphloom.sources.generators import draw

STATE = 50_000_000  # rows of (root, id) of a block, over all executors


def sample_roots(graph: Graph, k: int, seed: int = 7) -> DataFrame:
    """k roots drawn with replacement: (root) rows, each draw a hash over the ranked universe."""
    ids = graph.vertices.select("id").orderBy("id")
    ranked = checkpoint(ids.withColumn("at", F.monotonically_increasing_id()))
    parts = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    parts = checkpoint(parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"), "n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbered = ranked.join(F.broadcast(parts), F.shiftright("at", 33) == F.col("part")).select(
        F.col("id").alias("root"), (F.col("base") + (F.col("at") - F.shiftleft("part", 33))).alias("pick")
    )
    draws = ranked.sparkSession.range(k).select((draw(F.col("id"), 3, seed) % max(1, total)).alias("pick"))
    return draws.join(numbered, "pick").select("root")


def _by_components(graph: Graph, roots: DataFrame, bound: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, roots) of components of at most `bound` edges, with their label, and (edges, roots) of larger ones.

    Roots without edges are in neither.
    """
    labels = checkpoint(connected_components(Graph.from_edges(graph.edges)))
    edges = graph.edges.select("src", "dst").join(labels.withColumnRenamed("id", "src"), "src").select("src", "dst", "label")
    edges, seen = checkpoint_measured(edges, n=F.count(F.lit(1)))
    large = edges.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > bound).select("label")
    large = checkpoint(large) if seen["n"] > bound else large.limit(0)  # fewer than seen / bound
    roots = checkpoint(roots.join(labels.withColumnRenamed("id", "root"), "root").select("root", "times", "label"))
    part = lambda df, how: df.join(F.broadcast(large), "label", how)
    return part(edges, "left_anti"), part(roots, "left_anti"), part(edges, "left_semi"), part(roots, "left_semi")


def levels(graph: Graph, roots: DataFrame, local_edges: int = kernels.LOCAL_EDGES, component_edges: int = kernels.LOCAL_EDGES) -> DataFrame:
    """(root, id, level, sigma): depth and number of shortest paths of every vertex that each root reaches.

    local_edges: edges up to which the graph is broadcast; component_edges: and up to which a component is one task's.
    """
    roots = checkpoint(roots.select("root").distinct().withColumn("times", F.lit(1).cast("long")))
    if kernels.is_small(graph.edges, local_edges):
        return kernels.over_roots(kernels.LEVELS, graph.edges, roots)
    every = None
    if component_edges > 0:
        edges, some, large, roots_ = _by_components(graph, roots, component_edges)
        every = kernels.over_components(kernels.LEVELS, edges, some)
        ends = graph.edges.select(F.col("src").alias("root")).unionByName(graph.edges.select(F.col("dst").alias("root")))
        alone = roots.join(ends, "root", "left_anti")
        every = every.unionByName(alone.select("root", F.col("root").alias("id"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
        if roots_.isEmpty():
            return every
        graph, roots = Graph.from_edges(large), roots_
    edges = graph.by_source()
    found = _forward(edges, checkpoint(roots.select("root").distinct()))
    edges.unpersist()
    for d, (x, _) in enumerate(found):
        x = x.select("root", "id", F.lit(d).alias("level"), "sigma")
        every = x if every is None else every.unionByName(x)
    return every


def _forward(edges: DataFrame, roots: DataFrame) -> list[tuple[DataFrame, int]]:
    """Per depth ((root, id, sigma), rows): vertices first reached there and their numbers of shortest paths."""
    start = checkpoint(roots.select("root", F.col("root").alias("id"), F.lit(1.0).alias("sigma")))
    size = start.count()
    levels, visited, total = [(start, size)], start.select("root", "id"), size
    while True:
        front = levels[-1][0].select("root", F.col("id").alias("src"), "sigma")
        reached = edges.join(small(front, size), "src").groupBy("root", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        fresh, seen = checkpoint_measured(reached.join(small(visited, total), ["root", "id"], "left_anti"), n=F.count(F.lit(1)))
        size = seen["n"]
        if not size:
            return levels
        levels.append((fresh, size))
        total += size
        visited = visited.unionByName(fresh.select("root", "id"))
        if len(levels) % 8 == 0:
            visited = checkpoint(visited)


def _block(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, value): dependencies of all roots of the block, summed."""
    levels = _forward(edges, roots)
    below, n_below = levels[-1][0].select("root", "id", "sigma", F.lit(0.0).alias("delta")), levels[-1][1]
    total = None
    for here, n in reversed(levels[:-1]):
        give = below.select("root", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        paths = edges.join(small(here.select("root", F.col("id").alias("src")), n), "src").join(small(give, n_below), ["root", "dst"])
        got = paths.groupBy("root", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        below = here.join(small(got, n), ["root", "id"], "left")
        below = checkpoint(below.select("root", "id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")))
        n_below = n
        part = below.where("id <> root").select("id", F.col("delta").alias("value"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        return roots.select(F.col("root").alias("id"), F.lit(0.0).alias("value")).limit(0)
    return checkpoint(total.groupBy("id").agg(F.sum("value").alias("value")))


def betweenness(
    graph: Graph, roots: DataFrame | None = None, block: int | None = None, normalized: bool = False, scale: bool = False,
    local_edges: int = kernels.LOCAL_EDGES, component_edges: int = kernels.LOCAL_EDGES,
) -> DataFrame:
    """(id, bc) of the universe. roots(root): all vertices if None; a root listed twice counts twice.

    block: roots of a block (by STATE, if None); local_edges: edges up to which the graph is broadcast; component_edges: and
    up to which a component is one task's; larger ones go by distributed joins.
    """
    chosen = graph.vertices.select(F.col("id").alias("root")) if roots is None else roots.select("root")
    chosen = checkpoint(chosen.groupBy("root").agg(F.count(F.lit(1)).alias("times")))
    n, (picked, most, distinct) = graph.vertices.count(), chosen.agg(
        F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0)), F.count(F.lit(1))
    ).first()
    parts = []
    if kernels.is_small(graph.edges, local_edges):
        parts.append(kernels.over_roots(kernels.DEPENDENT, graph.edges, chosen))
        distinct = 0
    elif component_edges > 0:
        edges, some, large, chosen = _by_components(graph, chosen, component_edges)
        parts.append(kernels.over_components(kernels.DEPENDENT, edges, some))
        distinct, searched = chosen.count(), Graph.from_edges(large)
    else:
        searched = graph
    if distinct:
        edges = searched.by_source()
        blocks = max(1, -(-distinct // (block or max(1, STATE // max(1, n)))))
        for times in range(1, most + 1):  # draws beyond the first are few
            for b in range(blocks):
                some = chosen.where(F.col("times") >= times).where(F.pmod(F.xxhash64("root"), F.lit(blocks)) == b)
                parts.append(_block(edges, some.select("root")))
        edges.unpersist()
    out = graph.vertices.select("id", F.lit(0.0).alias("value"))
    for p in parts:
        out = out.unionByName(p)
    factor = 1.0
    if scale and picked:
        factor *= n / picked
    if normalized and n > 2:
        factor /= (n - 1) * (n - 2)
    return out.groupBy("id").agg((F.sum("value") * F.lit(factor)).alias("bc"))
