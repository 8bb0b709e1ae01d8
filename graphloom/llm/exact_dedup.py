"""Exact deduplication as a stateful stream, in DataFrame and SQL functions only.

Each document becomes a fingerprint row: SHA-256 of its text without white space, its length in code points, its
doc_id and a locator (its row in the staged table). The rows stream through an aggregation keyed by digest whose
state is on disk (RocksDB), has no watermark and never expires; the state of a digest is its count and the
identifier, length and locator of the row that stays. Equal keys are combined before the shuffle, so a text that
a third of all rows share costs one row a task. Digests seen more than once are then checked on the full bytes.

Defined results: null text counts as empty; all empty texts are one group; a null doc_id loses every tie and may be
the keep_id of its group only if all ids there are null; of fully repeated rows one stays; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import membership
from graphloom.session import Staging, checkpoint

WHITE = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated files
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _stream_groups(spark: SparkSession, st: Staging, prints: DataFrame, batch_files: int | None) -> DataFrame:
    """Runs the staged fingerprints through the keyed state; (digest, group_size, best) with one row a digest."""
    session = spark.newSession()
    for key, value in STREAM_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    reader = session.readStream.schema(prints.schema)
    if batch_files:
        reader = reader.option("maxFilesPerTrigger", batch_files)
    # bitwise not turns "smallest wins" into "largest wins" without overflow; null stays below all
    order = F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("locator").alias("locator"))
    grouped = reader.parquet(st.path("prints")).groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best")
    )
    out = st.path("groups")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # the same place if a batch runs again

    query = (
        grouped.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", st.path("stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*grouped.schema.fields, T.StructField("batch", T.IntegerType())])
    groups = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    if batch_files:  # a later batch replaces what an earlier one said of a digest
        last = F.max(F.struct("batch", "group_size", "best")).alias("last")
        groups = groups.groupBy("digest").agg(last).select("digest", "last.group_size", "last.best")
    return groups.select("digest", "group_size", "best")


def _collided(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests whose texts are not the same bytes. Reads only texts whose doc_id may be among the hits'."""
    bits = membership.bits_for(hits.count())
    maybe, _ = membership.split(docs, F.col("doc_id"), membership.bitmap(hits, F.col("doc_id"), bits), bits)
    norm = maybe.select(normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    ends = norm.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return ends.where("low <> high").select("digest")


def exact_dedup(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_files: int | None = None
) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, points.

    digest: of the normalised text; batch_files: staged files of one micro-batch (all, if None).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    with Staging(spark, "exact-dedup") as st:
        norm = docs.select("doc_id", F.length(text).cast("long").alias("points"), normalised(text).alias("norm"))
        prints = norm.select(
            "doc_id", "points", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256"),
            F.monotonically_increasing_id().alias("locator"),
        )
        prints = st.write(prints, "prints")
        if prints.isEmpty():
            none = T.StructType.fromDDL(
                "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, points long"
            )
            return spark.createDataFrame([], none)
        groups = _stream_groups(spark, st, prints, batch_files)
        rows = prints.join(groups, "digest").select(
            "doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size",
            (F.col("locator") == F.bitwise_not("best.locator")).alias("kept"), "text_sha256", "points", "digest",
        )
        rows = checkpoint(rows)
        bad = checkpoint(_collided(docs, rows.where("group_size > 1"), digest))
        if bad.isEmpty():
            return rows.drop("digest")
        return checkpoint(rows.join(bad, "digest", "left_anti").drop("digest").unionByName(_by_text(docs, bad, digest)))


def _by_text(docs: DataFrame, bad: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Decisions for the texts of collided digests, grouped by their full bytes."""
    t = docs.withColumn("norm", normalised(F.col("text"))).withColumn("digest", digest(F.col("norm")))
    t = t.join(bad, "digest", "left_semi").select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), "norm",
        F.monotonically_increasing_id().alias("locator"),
    )
    t = checkpoint(t)
    order = F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("locator").alias("locator"))
    g = t.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best"))
    return t.join(g, "norm").select(
        "doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size",
        (F.col("locator") == F.bitwise_not("best.locator")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"), "points",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, of any type. Only rows whose group has copies are shuffled.

    Of rows that share doc_id and text one stays, whichever of them where their other columns differ.
    """
    names = docs.columns
    made = checkpoint(exact_dedup(docs))
    many = made.where("group_size > 1")
    bits = membership.bits_for(many.count())
    maybe, alone = membership.split(docs, F.col("doc_id").cast("long"), membership.bitmap(many, F.col("doc_id"), bits), bits)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = maybe.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("k_id"),
        sha256(normalised(text)).alias("k_sha"), F.length(text).cast("long").alias("k_points"),
    )
    stay = made.where("kept").select(
        F.col("doc_id").alias("s_id"), F.col("text_sha256").alias("k_sha"), F.col("points").alias("k_points")
    )
    kept = keyed.join(stay, ["k_sha", "k_points"]).where(F.col("k_id").eqNullSafe(F.col("s_id")))
    # repeated rows have the same key: one of them stays. Only texts are ordered, as other columns may be of any type
    first = F.struct(F.col("row.text").isNull(), F.col("row.text"))
    one = kept.groupBy("k_sha", "k_points").agg(F.min_by("row", first).alias("row"))
    return alone.select([F.col(f"`{n}`") for n in names]).unionByName(one.select([F.col(f"row.`{n}`") for n in names]))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
