"""Substring deduplication of paragraphs by MinHash banding, exact verification and components.

A paragraph is a line of at least MIN_WORDS words; two are near copies if the Jaccard similarity of their sets of
WIDTH-word shingles (ASCII letters lower-cased, words are runs of anything but white space) is at least THRESHOLD.

Equal paragraphs are first made one. BANDS bands of ROWS MinHash values each deal the distinct ones into buckets: at
the threshold a pair shares a bucket with probability 1 - (1 - 0.8^3)^12 > 0.9998. Buckets with the same members are
searched once. Inside a bucket the exact similarity of each paragraph to all others is computed at once, and only a
spanning forest of the links is returned; a bucket of over SPLIT members is dealt as pairs of sub-buckets, each a task
of bounded size. Components of the forests are the classes; of each class the first occurrence (least doc_id, then
paragraph) stays and the others are removals.

Defined results: null and empty texts have no paragraphs; a null doc_id is last in the order of occurrences; fully
repeated rows, and others that share a doc_id, are occurrences of their own, of which the first staged is first; paragraphs of fewer words than
MIN_WORDS are never removed; an empty table gives an empty result; other columns play no part.

The query also has the passages (module passages) that repeat inside longer lines, or where copies break lines
differently, outside of the removals above. `remove_repeats` removes whole paragraphs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import membership, passages
from graphloom.llm import text as texts_of
from graphloom.llm.text import mix as _mix
from graphloom.operators.stars import star_components
from graphloom.session import Staging, checkpoint, release

WIDTH, THRESHOLD, MIN_WORDS = 5, 0.8, 20
BANDS, ROWS = 12, 3
SPLIT = 512
PACK = SPLIT  # paragraphs of one call, over many buckets: as many as of one sub-bucket, so that no call stands out
SEED = 29

_DRAWN = np.random.default_rng(SEED)
FACTOR = _DRAWN.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _DRAWN.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
POWER = np.uint64(0x9E3779B97F4A7C15)


class Paragraphs:
    """Paragraphs of some texts with their shingle hashes in one array."""

    def __init__(self, values: list[bytes], min_words: int, width: int):
        words = texts_of.Words(values)
        breaks = np.flatnonzero(words.bytes == 10)  # a line break ends each line, also the last of a text
        n = np.diff(np.searchsorted(words.start, breaks), prepend=0)
        long = n >= max(1, min_words)
        some = np.flatnonzero(long)
        starts = np.r_[0, breaks + 1]
        self.doc = np.searchsorted(words.first, starts[some], "right") - 1
        self.para = some - np.searchsorted(breaks, words.first[self.doc])
        points = words.points()
        base = points[words.first[self.doc]]
        self.start, self.end = points[starts[some]] - base, points[breaks[some]] - base
        self.size, self.width = n[some], width
        mine = np.repeat(long, n)
        self.pid = self._pids(words.low, words.start[mine], words.end[mine])
        self.hash = words.hash[mine]

    def _pids(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """128-bit hashes of the words of each paragraph, one space between two."""
        inside = np.zeros(len(low) + 1, np.int8)
        inside[start], inside[end] = 1, -1
        keep = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        keep[end] = True  # a byte of white space after each word
        plain = low.copy()
        plain[end] = 32
        text = memoryview(plain[keep].tobytes())
        at = np.cumsum(end - start + 1)
        ends = at[np.cumsum(self.size) - 1].tolist() if len(self.size) else []
        return [xxhash.xxh3_128_digest(text[a : b - 1]) for a, b in zip([0, *ends], ends)]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all shingles, first place of each paragraph)."""
        size, h = self.size, self.hash
        if not len(size):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = np.maximum(size - self.width + 1, 1)
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - first, n)
        out = np.zeros(len(at), np.uint64)
        short = size.min() < self.width
        left = np.repeat(np.minimum(size, self.width), n) if short else None
        for k in range(self.width):
            out = out * POWER + (np.where(left > k, h[np.minimum(at + k, len(h) - 1)], np.uint64(0)) if short else h[at + k])
        return _mix(out), first


def bands(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row per paragraph: a 64-bit key for each band."""
    if not len(first):
        return np.zeros((0, BANDS), np.uint64)
    out = np.zeros((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(first), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat((hashes * FACTOR[k] + SHIFT[k]) >> np.uint64(16), first)
            key = _mix(key * POWER + low)
        out[:, b] = key
    return out


def _paragraphs(docs: DataFrame, min_words: int, width: int, sets: bool) -> DataFrame:
    """sets: pid and the sorted set of shingles; else the place of each paragraph, pid and its band keys.

    docs: doc_id, text and, for places, row.
    """
    head = [F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row") if sets else F.col("row")]
    src = docs.select(*head, F.col("text").cast("string").alias("text"))
    texts_of.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in texts_of.slices(batch, "text"):
                found = Paragraphs(values, min_words, width)
                hashes, first = found.shingles()
                pid = pa.array(found.pid, type=pa.binary())
                if sets:
                    ends = np.r_[first[1:], len(hashes)]
                    some = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first, ends)]
                    yield pa.RecordBatch.from_arrays([pid, pa.array(some, type=pa.binary())], names=["pid", "shingles"])
                    continue
                keys = bands(hashes, first).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                place = [pa.array(x.astype(np.int32)) for x in (found.para, found.start, found.end, found.size)]
                of = pa.array(found.doc)
                head = [rows.column(0).take(of), rows.column(1).take(of)]
                yield pa.RecordBatch.from_arrays([*head, *place, pid, lists], names=["doc_id", "row", "paragraph", "start", "end", "n_words", "pid", "bands"])

    schema = "pid binary, shingles binary" if sets else "doc_id long, row long, paragraph int, start int, `end` int, n_words int, pid binary, bands array<long>"
    return src.mapInArrow(run, schema)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Label of each set: the least place linked to it through sets of this list."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets])
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    mark = np.zeros(len(distinct), np.int64)
    for i in range(n):
        if (label == label[0]).all():
            break
        mine = code[first[i] : first[i] + size[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[code], first)
        mark[mine] = 0
        near = both >= threshold * (size + size[i] - both) - 1e-9
        classes = np.unique(label[near])
        label[np.isin(label, classes)] = classes[0]
    return label


def _forest(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    u, v = [], []
    for _, bucket in rows.groupby("bucket", sort=False):
        pid = bucket["pid"].tolist()
        label = linked([np.frombuffer(s, np.uint64) for s in bucket["shingles"]], threshold)
        for i, j in enumerate(label.tolist()):
            if i != j:
                u.append(pid[i])
                v.append(pid[j])
    return pd.DataFrame({"u": u, "v": v})


def _links(docs: DataFrame, places: DataFrame, distinct: DataFrame, min_words: int, width: int, threshold: float, split: int) -> DataFrame:
    """Edges (u, v) between pids that connect every class of near copies."""
    dealt = distinct.select("pid", F.explode("bands").alias("key"))
    same = F.struct("n", "mix", "least")
    many = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pid")).alias("mix"), F.min(F.xxhash64(F.lit(1), "pid")).alias("least"))
    once = many.where("n > 1").groupBy(same.alias("same")).agg(F.min("key").alias("key")).select("key", "same.n")
    once = checkpoint(once)
    release(docs.sparkSession)
    shared, _ = membership.split(dealt, F.col("key"), membership.bitmap(once, F.col("key")))
    members = checkpoint(shared.join(once, "key"))
    pids = checkpoint(members.select("pid").distinct())
    # shingles of members only: first the documents that may hold one, then their paragraphs that may be one
    some, _ = membership.split(places.select("doc_id", "pid"), F.col("pid"), membership.bitmap(pids, F.col("pid")))
    within, _ = membership.split(docs.select("doc_id", "text"), F.col("doc_id").cast("long"), membership.bitmap(some, F.col("doc_id")))
    sets, _ = membership.split(_paragraphs(within, min_words, width, True), F.col("pid"), membership.bitmap(pids, F.col("pid")))
    sets = sets.join(pids, "pid", "left_semi").groupBy("pid").agg(F.first("shingles").alias("shingles"))
    half = split // 2
    m = members.withColumn("parts", F.when(F.col("n") > split, F.ceil(F.col("n") / half)).otherwise(1).cast("int"))
    m = m.withColumn("s", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
    m = m.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bucket = F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t"))
    packs = max(1, members.count() // PACK)
    pack = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(bucket)
    m = m.select(pack.alias("pack"), bucket.alias("bucket"), "pid").join(sets, "pid")
    return m.groupBy("pack").applyInPandas(lambda rows: _forest(rows, threshold), "u binary, v binary")


def _repeated(docs: DataFrame, min_words: int, width: int, threshold: float, split: int) -> DataFrame:
    """repeated_paragraphs of docs(doc_id, text, row), with the row of each."""
    with Staging(docs.sparkSession, "substring") as st:
        made = _paragraphs(docs, min_words, width, False).withColumn("at", F.monotonically_increasing_id())
        made = st.write(made, "paragraphs")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "paragraph", "at").alias("first")
        distinct = made.groupBy("pid").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands"))
        distinct = st.write(distinct, "distinct")
        release(docs.sparkSession)
        places = made.drop("bands")
        tied = star_components(_links(docs, places, distinct, min_words, width, threshold, split))
        rooted = distinct.drop("bands").join(tied.withColumnRenamed("u", "pid"), "pid", "left").withColumn("root", F.coalesce("root", "pid"))
        rooted = checkpoint(rooted)
        classes = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size")).where("class_size > 1")
        named = checkpoint(rooted.select("pid", "root").join(checkpoint(classes), "root").drop("root"))
        out = places.join(named, "pid").select(
            "doc_id", "paragraph", "start", "end", "n_words", F.col("keep.doc_id").alias("keep_id"),
            F.col("keep.paragraph").alias("keep_paragraph"), "class_size", (F.col("at") == F.col("keep.at")).alias("kept"), "row",
        )
        return checkpoint(out)


def print_of(docs: DataFrame) -> Column:
    """A key of a row made of its doc_id and text, so that rows which share a doc_id only are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def repeated_paragraphs(
    docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, threshold: float = THRESHOLD, split: int = SPLIT
) -> DataFrame:
    """One row per paragraph of docs(doc_id, text) that has a copy or near copy:

    doc_id, paragraph (line number from 0), start, end (code points, end exclusive), n_words, keep_id and keep_paragraph
    (the occurrence that stays: they name the class), class_size (occurrences), kept.
    """
    keyed = docs.select("doc_id", "text", F.lit(0).cast("long").alias("row"))
    return _repeated(keyed, min_words, width, threshold, split).drop("row")


def remove_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, threshold: float = THRESHOLD, split: int = SPLIT
) -> DataFrame:
    """docs with the removals cut out of their texts; other columns as they are. Rows without one are not shuffled.

    The rows are staged once with a locator each, and removals go by locator and line: rows that share a doc_id, or are
    the same throughout, each lose their own removals only.
    """
    with Staging(docs.sparkSession, "rows") as st:
        names = docs.columns
        back = [F.col(f"`{n}`") for n in names]
        whole = docs.select(F.struct(*back).alias("row"), F.monotonically_increasing_id().alias("locator"))
        whole = st.write(whole, "whole")
        keyed = whole.select("row.doc_id", "row.text", F.col("locator").alias("row"))
        gone = _repeated(keyed, min_words, width, threshold, split).where("NOT kept")
        gone = checkpoint(gone.groupBy(F.col("row").alias("g_row")).agg(F.collect_set("paragraph").alias("gone")))
        bits = membership.bits_for(gone.count())
        maybe, rest = membership.split(whole, F.col("locator"), membership.bitmap(gone, F.col("g_row"), bits), bits)
        maybe = maybe.join(gone, F.col("locator") == F.col("g_row"), "left")
        lines = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
        cut = [F.col(f"row.`{n}`") if n != "text" else F.array_join(lines, "\n").alias("text") for n in names]
        return checkpoint(rest.select([F.col(f"row.`{n}`") for n in names]).unionByName(maybe.select(cut)))


def repeated_text(docs: DataFrame) -> DataFrame:
    """The rows of repeated_paragraphs, and those of passages that repeat outside of its removals."""
    keyed = docs.select("doc_id", "text", print_of(docs).alias("row"))
    lines = _repeated(keyed, MIN_WORDS, WIDTH, THRESHOLD, SPLIT)
    release(docs.sparkSession)
    return lines.drop("row").unionByName(passages.repeated_passages(keyed, lines))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
