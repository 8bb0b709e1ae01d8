"""Work estimates: degrees as work, their prefix sums, and cut points of evenly loaded partitions.

Prefix sums are made in two levels over the sorted rows: the sums of the sort's partitions (a row each) meet in one small
window, ids only inside their partition. So ids may be any 64-bit numbers, dense or hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.session import checkpoint
from graphloom.sources.generators import draw


def listed(graph: Graph, zeros: bool = True, seed: int | None = None) -> DataFrame:
    """(id, degree) of all vertices, or of those with an out-edge; with a seed in a random order, which `at` numbers."""
    rows = graph.degrees() if zeros else graph.out_degrees()
    return rows if seed is None else numbered(rows, draw(F.col("id"), 5, seed), F.col("id"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in the given order, with at: consecutive numbers from 0."""
    rows = checkpoint(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rest = [c for c in rows.columns if c != "at"]
    return rows.join(F.broadcast(parts), part == F.col("part")).select(*rest, (F.col("base") + F.col("at") - F.shiftleft("part", 33)).alias("at"))


def prefix_work(graph: Graph, zeros: bool = True) -> DataFrame:
    """(id, degree, prefix): prefix is the work of all listed vertices with a smaller id."""
    work = checkpoint(listed(graph, zeros).orderBy("id").withColumn("at", F.monotonically_increasing_id()))
    work = work.withColumn("part", F.shiftright("at", 33))
    sums = work.groupBy("part").agg(F.sum("degree").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("base") + F.coalesce(F.sum("degree").over(inside), F.lit(0))
    return work.join(F.broadcast(sums), "part").select("id", "degree", prefix.alias("prefix"))


def partition_count(vertices: int, work: int) -> int:
    """200, 500 or 1000 by mean degree under 4, under 7 or more; never more than vertices."""
    mean = work / vertices if vertices else 0
    return max(1, min(vertices, 200 if mean < 4 else 500 if mean < 7 else 1000))


def work_partitions(graph: Graph, zeros: bool = True) -> DataFrame:
    """(part, needle, boundary): boundary is how many of the first n - 1 prefixes are below needle = total * part / parts."""
    prefixes = prefix_work(graph, zeros).persist()
    n, total = prefixes.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
    parts = partition_count(n, total)
    spark = prefixes.sparkSession
    # a prefix counts for every part whose needle is above it: from part ceil((prefix + 1) * parts / total) on
    last = prefixes.agg(F.max("id")).first()[0]
    steps = prefixes.where(F.col("id") < F.lit(last)) if last is not None else prefixes
    steps = steps.select(F.expr(f"cast(((prefix + 1) * {parts} + {max(1, total) - 1}) div {max(1, total)} as int)").alias("p"))
    counts = steps.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(parts + 1).select(F.col("id").cast("int").alias("part"))
    window = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # at most 1001 rows
    needle = F.expr(f"({total} * cast(part as bigint)) div {parts}").alias("needle")
    out = grid.join(counts, grid.part == counts.p, "left").select("part", needle, F.sum(F.coalesce("n", F.lit(0))).over(window).alias("boundary"))
    return out
