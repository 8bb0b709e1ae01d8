"""Passages that repeat across documents wherever lines break: inside longer lines, or wrapped into short ones.

A text is one sequence of words (ASCII letters lower-cased; runs of anything but white space), line breaks being white
space. Of every WINDOW consecutive runs of GRAM words the one of least hash is chosen, so two texts that share any run
of GRAM + WINDOW - 1 = 21 words share a chosen one. A passage of over 50 words and its near copy (Jaccard of 5-word
shingles at least 0.8) share such a run: an edit costs 5 shingles, so there is at most one edit in 45 words.

Chosen runs of more than one document, equal by 128 bits of hash, are the hits. A bounded bitmap of the shared hashes is
sent to the workers, so that other runs never leave them; an exact join follows. The first occurrence (least doc_id,
null last, then place) of a run stays. Hits of a document that overlap or are a few words (APART) apart and have their
first occurrences side by side in one document, but for an edit of up to EDIT words, are one passage. Its ends are those
of its hits: up to WINDOW - 1 words of the shared run may be left over on each side, so every equal run of
SHORTEST + 2 (WINDOW - 1) = 35 words is a passage, and hits that span fewer than SHORTEST words are none. Hits that touch
a removed line are left out first, so what stays of a class is never removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import membership
from graphloom.llm import text as texts_of
from graphloom.llm.text import mix as _mix
from graphloom.session import checkpoint, release

GRAM, WINDOW = 16, 6  # GRAM is a power of 2
EDIT, APART = 2, 8  # words by which the sides of an edit may be shifted, and lie apart beyond a run
SHORTEST = 25  # words from the first hit of a passage to the end of its last
FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
HIT = "row long, doc_id long, print long, key long, mark long, pos int, start int, `end` int, paragraph int"


def _rolled(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A hash of each GRAM words in a row, from sums of all words before: none of the words is mixed twice."""
    power = np.cumprod(np.full(len(h), factor))
    sums = np.cumsum(np.r_[np.uint64(0), h * power])
    back = np.cumprod(np.full(len(h) - GRAM + 1, np.uint64(pow(int(factor), -1, 1 << 64))))
    return _mix((sums[GRAM:] - sums[:-GRAM]) * back)


def _marks(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another hash of the runs at these places."""
    mark = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        mark = _mix(mark * FACTORS[1] + h[at + k])
    return mark


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` values in a row."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def chosen(g: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Places whose hash is the least of some WINDOW in a row (of all, where there are fewer) of their text, ascending.

    sizes: how many of the hashes are of each text, none of them 0; all are of one without it.
    """
    sizes = np.array([len(g)]) if sizes is None else sizes
    ends = np.cumsum(sizes)
    first = ends - sizes
    few = np.repeat(sizes < WINDOW, sizes)
    whole = few & (g == np.repeat(np.minimum.reduceat(g, first), sizes))
    if len(g) < WINDOW:
        return np.flatnonzero(whole)
    least = _slide(g, WINDOW, np.minimum)
    left = np.repeat(ends, sizes) - np.arange(len(g))
    least[left[: len(least)] < WINDOW] = 0  # of two texts
    edge = np.zeros(WINDOW - 1, g.dtype)
    return np.flatnonzero(whole | ~few & (_slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == g))


def runs(words: texts_of.Words) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first words) of the chosen runs of each text."""
    n = np.diff(words.word)
    sizes = np.maximum(n - GRAM + 1, 0)
    if not sizes.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some = np.flatnonzero(np.arange(n.sum()) < np.repeat(words.word[:-1] + sizes, n))
    g = _rolled(words.hash, FACTORS[0])[some]
    at = chosen(g, sizes[sizes > 0])
    return g[at], some[at]


def _runs(docs: DataFrame, bitmap: bytes | None) -> DataFrame:
    """The distinct keys of the chosen runs of each document; or, with a bitmap of keys, the places of those in it."""
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"), F.col("row").alias("print"),
    )
    spark = docs.sparkSession
    texts_of.bound_batches(spark)
    shipped = None if bitmap is None else spark.sparkContext.broadcast(bitmap)
    names = [f.split()[0].strip("`") for f in HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if shipped is None else np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            for rows, values in texts_of.slices(batch, "text"):
                words = texts_of.Words(values)
                g, at = runs(words)
                if held is None:
                    edges = np.flatnonzero(np.diff(words.of[at])) + 1
                    keys = [np.unique(x) for x in np.split(g, edges)]  # those of a text once
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])
                    continue
                bit = (g & np.uint64(8 * len(held) - 1)).astype(np.int64)
                hit = (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                g, at = g[hit], at[hit]
                if not len(at):
                    continue
                text = words.of[at]
                first, to = words.first[text], at + GRAM - 1
                points, lines = words.points(), np.cumsum(np.r_[False, words.bytes == 10], dtype=np.int32)
                start, end = words.start[at], words.end[to]
                small = [at - words.word[text], points[start] - points[first], points[end] - points[first], lines[start] - lines[first]]
                of = pa.array(text)
                head = [rows.column(k).take(of) for k in (2, 0, 3)]
                wide = [pa.array(x.view(np.int64)) for x in (g, _marks(words.hash, at))]
                yield pa.RecordBatch.from_arrays([*head, *wide, *[pa.array(x.astype(np.int32)) for x in small]], names=names)

    return src.mapInArrow(run, "key long" if bitmap is None else HIT)


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """The bitmap of keys(key), which are hashes, by their lowest bits: bits / 8 bytes, whatever the number of keys."""
    low = keys.select(F.pmod("key", F.lit(bits)).alias("h"))
    parts = low.groupBy(F.expr(f"h div {membership.PER_ROW}").alias("b")).agg(F.bitmap_construct_agg(F.expr(f"h % {membership.PER_ROW}")).alias("m"))
    out = bytearray(bits // 8)
    size = membership.PER_ROW // 8
    for r in parts.collect():
        out[r.b * size : (r.b + 1) * size] = r.m
    return bytes(out)


def repeated_passages(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per passage of docs(doc_id, text, row) outside of the removals among `lines`, with the columns of `lines`
    but row: a key of each document, in docs and in lines.

    paragraph and keep_paragraph are the lines in which the passage and the occurrence that stays start; class_size is
    the number of occurrences of the passage's most frequent run.
    """
    spark = docs.sparkSession
    shared = _runs(docs, None).groupBy("key").count().where("count > 1").select("key")
    shared = checkpoint(shared)
    release(spark)
    hits = _runs(docs, _bitmap(shared, membership.bits_for(shared.count())))
    gone = lines.where("NOT kept").groupBy(F.col("row").alias("print")).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    hits = hits.join(shared, "key", "left_semi").join(gone, "print", "left")
    hits = hits.where("gone IS NULL OR NOT exists(gone, x -> x.start < end AND x.end > start)").drop("print", "gone")
    hits = checkpoint(hits)
    release(spark)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos", "paragraph")).alias("first")
    classes = hits.groupBy("key", "mark").agg(first, F.count(F.lit(1)).alias("n"), F.min("row").alias("a"), F.max("row").alias("b"))
    classes = checkpoint(classes.where("a < b").drop("a", "b"))
    named = hits.join(classes, ["key", "mark"])
    w = Window.partitionBy("row").orderBy("pos")
    off = F.col("first.pos") - F.col("pos")
    side = (F.col("first.row") == F.lag("first.row").over(w)) & (F.abs(off - F.lag(off).over(w)) <= EDIT) & (
        F.col("pos") <= F.lag("pos").over(w) + GRAM + APART
    )
    named = named.withColumn("new", F.when(side, 0).otherwise(1)).withColumn("passage", F.sum("new").over(w))
    out = named.groupBy("row", "passage").agg(
        F.any_value("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("pos") - F.min("pos") + GRAM).alias("n_words"), F.min("first").alias("keep"), F.max("n").alias("class_size"),
        F.min("pos").alias("pos"),
    )
    return checkpoint(out.where(F.col("n_words") >= SHORTEST).select(
        "doc_id", "paragraph", "start", "end", "n_words", F.col("keep.doc_id").alias("keep_id"), F.col("keep.paragraph").alias("keep_paragraph"),
        "class_size", ((F.col("keep.row") == F.col("row")) & (F.col("keep.pos") == F.col("pos"))).alias("kept"),
    ))
