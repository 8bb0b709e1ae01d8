"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are of the whole text (bytes, words and lines); labels, lang, source and doc_id are never among them. The
trees are trained on the driver on a sample of at most SAMPLE labelled documents (the ones with the smallest hash of
seed and doc_id, so the same at every run), then flattened into arrays: one row a tree, one column a node of
a complete binary tree. Scoring walks all trees of all documents of a slice at once, one level a step.

Defined results: null text counts as empty and is scored; null doc_ids are scored and not held out; labels that
repeat a doc_id are averaged (0.5 counts as 1); with no labels, or of one class only, every score is the share of
label 1 (0.5 without labels); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import text as texts_of

SAMPLE = 20_000  # labelled documents that training may take, of any number
TREES, DEPTH, BINS, RATE, LAMBDA, MIN_ROWS = 60, 5, 64, 0.2, 1.0, 20
SEED = 5

_GROUPS = {  # byte classes whose shares are statistics
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "high": range(128, 256),
    "white": (9, 10, 11, 12, 13, 32), "newline": (10,), "stop": b".?!", "comma": b",;:", "bang": b"!", "pipe": b"|",
    "symbol": b"#$%&*@^~<>{}[]\\_=+", "quote": b"\"'()-", "slash": b"/",
}
NAMES = [*_GROUPS, "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "log_lines", "distinct_lines",
         "line_words", "short_lines", "stop_words", "capital_words", "symbol_words", "distinct_pairs", "entropy"]
_TABLE = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS.values()):
    _TABLE[list(_g), _i] = 1


def statistics(data: bytes) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    share = (hist @ _TABLE / n).tolist()
    words = data.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = data.split(b"\n")
    p = hist[hist > 0] / n
    pairs = len(set(zip(words, words[1:])))
    marks = b"#$%&*!|"
    return share + [
        float(np.log1p(len(data))), float(np.log1p(len(words))), sum(map(len, words)) / w, len(counts) / w,
        max(counts.values(), default=0) / w, float(np.log1p(len(lines))), len(set(lines)) / len(lines), w / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), sum(x[-1] in b".?!" for x in words) / w,
        sum(65 <= x[0] <= 90 for x in words) / w, sum(x[-1] in marks for x in words) / w, pairs / max(1, w - 1),
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
    ]


@dataclass
class Forest:
    """Flattened trees: node i of a tree has children 2i+1 and 2i+2; a node without a split sends all to the left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees and len(x):
            node = np.zeros((len(x), trees), dtype=np.int64)
            row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
            while node[0, 0] < inner:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosts depth-wise trees on the logistic loss over quantile-binned columns."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    inner, leaves = 2**depth - 1, 2**depth
    if len(np.unique(y)) < 2:
        return Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    flat = binned + np.arange(f) * BINS
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    feature, threshold = np.zeros((trees, inner), int), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (f * BINS) + flat).ravel()
            size = width * f * BINS

            def hist(v: np.ndarray) -> np.ndarray:
                return np.bincount(slot, np.repeat(v, f), size).reshape(width, f, BINS).cumsum(axis=2)

            g, h, c = hist(grad), hist(hess), hist(np.ones(n))
            gt, ht, ct = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + LAMBDA) + (gt - g) ** 2 / (ht - h + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain = np.where((c >= MIN_ROWS) & (ct - c >= MIN_ROWS), gain, -1).reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        leaf[t] = -RATE * g / (h + LAMBDA)
        raw += leaf[t][at]
    return Forest(base, feature, threshold, leaf)


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3


def _mapped(df: DataFrame, names: list[str], to: str, width: int, work) -> DataFrame:
    src = df.select(*[F.col(f"`{n}`") for n in names], F.col("text").cast("string").alias("__text"))
    texts_of.bound_batches(df.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in texts_of.slices(batch, "__text"):
                x = np.array([statistics(v) for v in values], dtype=np.float64).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], work(x)], names=[*names, to.split()[0]])

    return src.mapInArrow(run, f"{kept}, {to}")


def _features(df: DataFrame) -> DataFrame:
    def work(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))

    return _mapped(df, ["doc_id"], "x array<double>", len(NAMES), work)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest from labels(doc_id, quality) whose remainder is not 1. Reads the texts of the sample only."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    rows = rows.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id")) != 1)
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample's ids are at most `sample` rows of 16 bytes
    picked = keyed.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi")
    found = {r.doc_id: r.y for r in rows.collect()}
    # at most `sample` rows of some numbers each, unless doc_ids repeat; one job reads them all
    got = sorted((r.doc_id, r.x) for r in _features(picked).collect()) if found else []
    if not got:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.array([x for _, x in got]), np.array([found[i] for i, _ in got]))


def score(docs: DataFrame, forest: Forest, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all, if None) and score (double)."""
    keep = docs.columns if keep is None else keep
    name = "score"
    while name in keep:
        name = f"_{name}"
    return _mapped(docs, keep, f"{name} double", len(NAMES), lambda x: pa.array(forest.score(x)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of at least 0.5, with all their columns."""
    scored = score(docs, train(docs, labels))
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select([F.col(f"`{n}`") for n in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, forest, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
