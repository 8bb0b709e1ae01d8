"""A corpus pipeline over documents: quality, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet to the
shared folder and read again, so a lost executor repeats at most one stage's tasks. Every stage but the last returns
the columns of documents, and further ones of any name and type as they are.

Defined results, by stage: null and empty texts are scored like any other (quality), are copies of each other (exact
dedup: one stays), have fingerprint zero (simhash), size 0 (mixing: at most twice, like any document) and no ids
(bpe). A null doc_id loses every tie. Of rows that share doc_id and text one stays. Texts of any length are read whole.
Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, exact_dedup, mixing, quality, simhash
from graphloom.session import Staging, checkpoint


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (32-bit little-endian), with digests of the ids and of the text decoded from them."""
    made = bpe.round_trip(docs, bpe.vocabulary(), keep=["doc_id", "source"])
    return made.select(
        "doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None  # boosted trees and BPE are beyond SQL; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Staging(spark, "pipeline") as st:
        before = ""
        for name, stage in STAGES[:-1]:
            docs = st.write(stage(spark, docs, sf_dir), name)
            if before:
                st.drop(before)
            before = name
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
