"""Session helpers: the shared folder that survives lost executors, and lineage cuts that live in it."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.functions import broadcast

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Read from the session; where none is set, a local master gets one of its own."""
    base = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set(CHECKPOINT_KEY, base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage with a reliable checkpoint: its files are in the shared folder, so a lost executor loses nothing.

    Spark lets a checkpoint keep the partitioning, ordering and constraints of the plan it cuts, under every name its
    columns had; in a loop of joins these multiply from round to round until planning takes longer than the work. So the
    frame that is returned has the checkpoint's rows and schema only.
    """
    spark = df.sparkSession
    shared_folder(spark)
    made = df.checkpoint(eager=eager)
    plan = made._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRDD" and not plan.getClass().getSimpleName().startswith("LogicalRDD"):
        return made
    try:  # not a public method: without it the checkpoint is returned as Spark made it, which is right, but slower in loops
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), made._jdf.schema(), False), spark)
    except (AttributeError, TypeError, Py4JError):
        return made


def checkpoint_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """(checkpoint of df, values of aggregates over its rows): the aggregates ride on the checkpoint's own job."""
    seen = Observation()
    made = checkpoint(df.observe(seen, *[m.alias(n) for n, m in measures.items()]))
    return made, seen.get


BROADCAST_ROWS = 200_000  # of narrow state rows (a few numbers each): some MB at most


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it was counted to have few rows; else as it is, to be shuffled."""
    return broadcast(df) if rows <= BROADCAST_ROWS else df


RELEASE_KEY = "spark.graphloom.release"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the JVM collects.

    A collection pauses the driver: where it is shared, spark.graphloom.release=false leaves it to Spark's own cleaner.
    """
    if spark.conf.get(RELEASE_KEY, "true").lower() == "false":
        return
    gc.collect()
    for wait in (0.3, 0):  # Python's references are dropped in the JVM a little after the first call; the second finds them gone
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


class Staging:
    """A folder below the shared one for tables that one operator writes and reads before it returns.

    Used as a context manager; the folder is deleted through Hadoop's file system on leaving, so any store works.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/staging-{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> "Staging":
        return self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and returns the table read again: the plan above it is cut."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: object) -> None:
        self.drop()
