"""Incremental triangles and Katz scores over a stream of update batches.

Batches arrive as rows (batch_id, op, src, dst) of a file stream; foreachBatch applies them in order of batch_id. The
state is a set of checkpointed tables in the shared folder, so lost executors lose nothing. With a state path every
micro-batch also leaves the state there: a driver that starts again with the same paths goes on from the last one that was
left whole, whether or not the stream had noted it as done.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import katz as katz_ops
from graphloom.operators import triangles as triangle_ops
from graphloom.session import checkpoint
from graphloom.sources import updates

BATCH = "batch_id int, op string, src long, dst long"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _saved(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose state is whole below path, ascending."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    names = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(where)]
    return sorted(int(n) for n, full in names if n.isdigit() and fs.exists(_path(spark, f"{full}/done/_SUCCESS")[0]))


class _Kept:
    """A state of named tables and a few numbers that can be left in a folder and taken up again."""

    def tables(self) -> dict[str, DataFrame]:
        raise NotImplementedError

    def numbers(self) -> dict:
        return {}

    def take(self, tables: dict[str, DataFrame], numbers: dict) -> None:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        for name, rows in self.tables().items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
        # written last: a state without it is not whole
        spark.createDataFrame([(json.dumps(self.numbers()),)], "numbers string").write.mode("overwrite").parquet(f"{path}/done")

    def restore(self, spark: SparkSession, path: str) -> None:
        read = {name: checkpoint(spark.read.parquet(f"{path}/{name}")) for name in self.tables()}
        self.take(read, json.loads(spark.read.parquet(f"{path}/done").first().numbers))


class TriangleState(_Kept):
    """Edges and triangle counts (convention six) of a simple symmetric graph under insertions and deletions."""

    def __init__(self, graph: Graph, counts: DataFrame | None = None):
        self.graph = graph
        self.counts = checkpoint(counts if counts is not None else triangle_ops.per_vertex(graph))

    def tables(self) -> dict[str, DataFrame]:
        return {"vertices": self.graph.vertices, "edges": self.graph.edges, "counts": self.counts}

    def take(self, tables: dict[str, DataFrame], numbers: dict) -> None:
        self.graph, self.counts = Graph(tables["vertices"], tables["edges"]), tables["counts"]

    def _add(self, change: DataFrame, sign: int) -> None:
        by = change.select("id", (F.col("triangles") * sign).alias("by"))
        ids = self.graph.vertices
        self.counts = checkpoint(
            ids.join(self.counts, "id", "left").join(by, "id", "left")
            .select("id", (F.coalesce("triangles", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("triangles"))
        )

    def insert(self, batch: DataFrame) -> DataFrame:
        """Applies a batch and returns its changes (id, triangles)."""
        fresh = checkpoint(updates.new_edges(batch, self.graph.edges))
        change = checkpoint(triangle_ops.delta(self.graph.edges, fresh))
        after = updates.insert(self.graph, fresh)
        self.graph = Graph(checkpoint(after.vertices), checkpoint(after.edges))
        self._add(change, 1)
        return change

    def delete(self, batch: DataFrame) -> DataFrame:
        """A deletion changes what inserting the same edges afterwards would, with the sign turned."""
        gone = checkpoint(updates.gone_edges(batch, self.graph.edges))
        after = updates.delete(self.graph, gone)
        self.graph = Graph(self.graph.vertices, checkpoint(after.edges))
        change = checkpoint(triangle_ops.delta(self.graph.edges, gone))
        self._add(change, -1)
        return change.select("id", (-F.col("triangles")).alias("triangles"))


class KatzState(_Kept):
    """Katz history of fixed length and alpha under insertions and deletions. Alpha is that of the given graph, or of
    top_degree, the greatest degree that is expected. Raises top_degree_grew if a batch lifts the
    greatest degree past the one alpha was made for: scores stay right, bounds would not be."""

    def __init__(self, graph: Graph, max_iterations: int = 20, k: int = 100, top_degree: int | None = None):
        made = katz_ops.katz(graph, max_iterations, k, top_degree, keep_history=True)
        self.graph, self.alpha, self.history = graph, made.alpha, made.history
        self.top_degree, self.top_degree_grew = round(1 / made.alpha) - 1, False

    def tables(self) -> dict[str, DataFrame]:
        rows = [h.select(F.lit(i).alias("i"), "id", "c") for i, h in enumerate(self.history)]
        history = rows[0]
        for x in rows[1:]:
            history = history.unionByName(x)
        return {"vertices": self.graph.vertices, "edges": self.graph.edges, "history": history}

    def numbers(self) -> dict:
        return {"alpha": self.alpha, "top_degree": self.top_degree, "grew": self.top_degree_grew, "directed": self.graph.directed, "length": len(self.history)}

    def take(self, tables: dict[str, DataFrame], numbers: dict) -> None:
        self.graph = Graph(tables["vertices"], tables["edges"], numbers["directed"])
        self.alpha, self.top_degree, self.top_degree_grew = numbers["alpha"], numbers["top_degree"], numbers["grew"]
        self.history = [tables["history"].where(F.col("i") == i).select("id", "c") for i in range(numbers["length"])]

    def _apply(self, after: Graph, batch: DataFrame, sign: int) -> None:
        self.history = katz_ops.update(self.history, after, batch, sign, self.alpha)
        self.graph = after
        self.top_degree_grew |= katz_ops.max_degree(after) > self.top_degree

    def insert(self, batch: DataFrame) -> None:
        fresh = checkpoint(updates.new_edges(batch, self.graph.edges, not self.graph.directed))
        after = updates.insert(self.graph, fresh)
        after = Graph(checkpoint(after.vertices), checkpoint(after.edges), after.directed)
        fresh_ids = after.vertices.join(self.graph.vertices, "id", "left_anti")
        self.history = [
            h.unionByName(fresh_ids.select("id", F.lit(1.0 if i == 0 else 0.0).alias("c"))) for i, h in enumerate(self.history)
        ]
        self._apply(after, fresh, 1)

    def delete(self, batch: DataFrame) -> None:
        gone = checkpoint(updates.gone_edges(batch, self.graph.edges, not self.graph.directed))
        after = updates.delete(self.graph, gone)
        self._apply(Graph(after.vertices, checkpoint(after.edges), after.directed), gone, -1)

    def scores(self) -> DataFrame:
        return katz_ops.scores_of(self.history)


def run_stream(spark: SparkSession, state: _Kept, path: str, checkpoint_path: str, files_per_batch: int = 1, state_path: str | None = None) -> int:
    """Feeds every batch under path (Parquet, schema BATCH) to state.insert and state.delete; micro-batches run.

    state_path: a folder that outlives the driver, for the state after each of the last two micro-batches; if it holds one,
    the state given is replaced by the last of them.
    """
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    saved = _saved(spark, state_path) if state_path else []
    if saved:
        state.restore(spark, f"{state_path}/{saved[-1]}")
    done = saved[-1] if saved else -1
    ran = 0

    def apply(rows: DataFrame, number: int) -> None:
        nonlocal done, ran
        if number <= done:  # a repeated micro-batch is in the state
            return
        rows = rows.persist()
        for r in rows.select("batch_id", "op").distinct().orderBy("batch_id", "op").collect():  # a few per micro-batch
            some = rows.where((F.col("batch_id") == r.batch_id) & (F.col("op") == r.op)).select("src", "dst")
            (state.insert if r.op == "insert" else state.delete)(some)
        rows.unpersist()
        if state_path:
            state.save(spark, f"{state_path}/{number}")
            for old in _saved(spark, state_path)[:-2]:
                where, fs = _path(spark, f"{state_path}/{old}")
                fs.delete(where, True)
        done, ran = number, ran + 1

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start().awaitTermination()
    return ran
