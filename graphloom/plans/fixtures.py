"""Graphs of the shared test tables: S (sparse, symmetric), D (dense, symmetric), T (directed transitions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import triangles
from graphloom.session import Staging, checkpoint, release


def _shared_orders(spark: SparkSession, sf_dir: str, least: float | None) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if least is not None:
        lines = lines.where(F.col("l_quantity") >= least)
    p = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("v")).repartition("o").distinct()  # dealt once, for the join too
    pairs = p.withColumnRenamed("v", "src").join(p.withColumnRenamed("v", "dst"), "o")
    return pairs.where("src <> dst").select("src", "dst").distinct()


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that share an order, over lines of quantity 45 or more."""
    return Graph.from_edges(checkpoint(_shared_orders(spark, sf_dir, 45)))


def sparse_universe(spark: SparkSession, sf_dir: str) -> Graph:
    """The same with every part as a vertex."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    return sparse(spark, sf_dir).with_universe(checkpoint(parts))


def dense(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that share an order, over all lines."""
    return Graph.from_edges(checkpoint(_shared_orders(spark, sf_dir, None)))


def on_dense_pairs(spark: SparkSession, sf_dir: str, work: Callable[[Graph], DataFrame]) -> DataFrame:
    """work(the dense graph), checkpointed: the graph, each edge once, is staged as Parquet while work runs.

    A checkpoint of both directions takes some 80 bytes an edge, the table about 6.
    """
    with Staging(spark, "dense") as st:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("v"))
        p = lines.repartition("o").distinct()  # dealt once, for the distinct rows and both sides of the join
        pairs = p.withColumnRenamed("v", "src").join(p.withColumnRenamed("v", "dst"), "o").where("src < dst").select("src", "dst").distinct()
        pairs = st.write(pairs, "pairs")
        if pairs.count() > triangles.TURN_EDGES:
            release(spark)  # the shuffle files
        return checkpoint(work(Graph.from_pairs(pairs)))


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """From each event's user to the next event's, where they differ. The order over all events is global by nature: one
    window holds two narrow columns of the stream table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    after = F.lead("user_id").over(Window.orderBy("ts", "event_id"))
    pairs = events.select(F.col("user_id").alias("src"), after.alias("dst")).where("dst is not null and src <> dst")
    return Graph.from_edges(checkpoint(pairs.distinct()), directed=True)


S_SQL = """p AS (SELECT DISTINCT l_orderkey o, l_partkey v FROM lineitem WHERE l_quantity >= 45),
e AS MATERIALIZED (SELECT DISTINCT a.v AS src, b.v AS dst FROM p a JOIN p b USING (o) WHERE a.v <> b.v)"""
D_SQL = S_SQL.replace(" WHERE l_quantity >= 45", "")
T_SQL = """e AS MATERIALIZED (SELECT DISTINCT u AS src, v AS dst FROM
 (SELECT user_id u, lead(user_id) OVER (ORDER BY ts, event_id) v FROM events) WHERE v IS NOT NULL AND u <> v)"""
# Bucket of an edge, as in sources.generators.bucket.
BUCKET = "(least(src, dst) * 31 + greatest(src, dst)) % 10"
