"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints: ASCII letters are lower-cased, words are runs of anything but white space, shingles are `width` words
joined by a space, each hashed by XXH64 (seed 42); a bit is 1 if it is set in over half the hashes.

Links (at most `distance` differing bits) are searched among distinct fingerprints. 64 bits in m blocks: two linked
fingerprints agree in m - distance of them, so each is dealt to one bucket per choice of those blocks; m grows with
the number of fingerprints, which keeps buckets small. Inside a bucket the fingerprints are sorted by Gray rank and
groups of 8 become nodes of a tree; a node keeps the bits its members share, a child only those its parent has
not, so a search adds up differences on the way down and drops whole groups once they pass the distance. A bucket
larger than SPLIT is dealt as pairs of sub-buckets, each a task of bounded size. A bucket returns a spanning forest
of its links, never its pairs; components join the forests.

Defined results: null or empty text has fingerprint zero, linked like any other; fewer words than `width` are one
shingle; repeated rows share fingerprint and component; null doc_ids never name a component unless all are null;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import membership, text
from graphloom.operators.stars import star_components
from graphloom.session import checkpoint

WIDTH, DISTANCE, SEED = 4, 4, 42
FANOUT = 8
SPLIT = 4096  # members of a bucket, or of two sub-buckets
PACK = 40_000  # rows of one call, over many buckets
FRONTIER = 2_000_000  # search states held at once


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        octets = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, column: str, width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` and fp (long: the 64 bits) of the text in `column`."""
    keep = list(keep or [])
    text.bound_batches(df.sparkSession)
    src = df.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{column}`").cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text.slices(batch, "__text"):
                fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
                arrays = [*rows.columns[: len(keep)], pa.array(fps)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "fp"])

    return src.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """The tree over fingerprints sorted by (bucket, Gray rank); all buckets of a call are searched together."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        n = len(codes)
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, n])
        self.codes, self.levels = codes, []
        start, mask, pattern = np.arange(n), np.full(n, ~np.uint64(0)), codes
        lead, count = first, size  # of each bucket: its first node and its nodes, on the level below
        while True:
            groups = -(-count // fanout)
            base = np.r_[0, np.cumsum(groups)]
            child = np.repeat(lead, groups) + fanout * (np.arange(base[-1]) - np.repeat(base[:-1], groups))
            shared = np.bitwise_and.reduceat(mask, child) & ~self._differ(pattern, child)
            # a child keeps what its parent has not
            of = np.repeat(np.arange(base[-1]), np.diff(np.r_[child, len(mask)]))
            self.levels.append((start, mask & ~shared[of], pattern, child))
            start, mask, pattern = start[child], shared, pattern[child]
            lead, count = base[:-1], groups
            if len(count) == 0 or count.max() <= fanout:
                break
        self.top = (start, mask, pattern)
        self.lead, self.count = np.repeat(lead, size), np.repeat(count, size)  # of each code's bucket
        self.size = np.repeat(size, size)
        self.last = n

    @staticmethod
    def _differ(pattern: np.ndarray, child: np.ndarray) -> np.ndarray:
        head = np.repeat(pattern[child], np.diff(np.r_[child, len(pattern)]))
        return np.bitwise_or.reduceat(pattern ^ head, child)

    def pairs(self, q: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, of all links of the codes at places q in their own buckets."""
        node = _spread(self.lead[q], self.count[q])
        who = np.repeat(q, self.count[q])
        start, mask, pattern = self.top
        who, node, acc = self._step(who, node, np.zeros(len(who), np.uint8), start, mask, pattern, len(mask), distance)
        for start, mask, pattern, child in reversed(self.levels):
            stop = np.r_[child[1:], len(mask)]
            some = stop[node] - child[node]
            below = _spread(child[node], some)
            who, node, acc = self._step(np.repeat(who, some), below, np.repeat(acc, some), start, mask, pattern, len(mask), distance)
        return who, node

    def _step(self, who, node, acc, start, mask, pattern, n, distance):
        stop = np.r_[start[1:], self.last]
        ahead = stop[node] > who + 1  # something behind the query in this group
        who, node, acc = who[ahead], node[ahead], acc[ahead]
        acc = acc + np.bitwise_count((self.codes[who] ^ pattern[node]) & mask[node])
        near = acc <= distance
        return who[near], node[near], acc[near]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then those of first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of linked places: label becomes the least place of each class."""
    while len(a):
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            return
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(bucket: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code) that connect what is linked inside each bucket; int64 in and out."""
    codes = fp.view(np.uint64)
    order = np.lexsort((gray_rank(codes), bucket))
    codes = codes[order]
    index = GrayIndex(bucket[order], codes)
    label = np.arange(len(codes))
    cost = np.cumsum(index.size)
    at = 0
    while at < len(codes):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, "right")))
        _join(label, *index.pairs(np.arange(at, upto), distance))
        at = upto
    tied = np.flatnonzero(label != np.arange(len(codes)))
    return codes[tied].view(np.int64), codes[label[tied]].view(np.int64)


def masks(m: int, distance: int) -> list[int]:
    """One mask per choice of m - distance of m blocks, as signed 64-bit integers."""
    edge = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(m)]
    found = [sum(block[i] for i in some) for some in combinations(range(m), m - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def blocks_for(n: int, distance: int) -> int:
    m = distance + 1
    while m < 2 * distance + 2 and n / 2 ** (64 * (m - distance) / m) > 256:
        m += 1
    return m


def links(fps: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """fps(fp long, distinct) -> edges (u, v) that connect every class of linked fingerprints."""
    n = fps.count()
    keys = masks(blocks_for(n, distance), distance)
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(keys)])).alias("b"))
    dealt = dealt.select("fp", "b.k", "b.v")
    many = dealt.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = dealt.join(many, ["k", "v"])
    half = split // 2
    dealt = dealt.withColumn("parts", F.when(F.col("n") > split, F.ceil(F.col("n") / half)).otherwise(1).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bucket = F.xxhash64("k", "v", F.least("s", "t"), F.greatest("s", "t"))
    packs = max(1, n * len(keys) // PACK)
    pack = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("k", "v"), F.lit(packs))).otherwise(bucket)
    dealt = dealt.select(pack.alias("pack"), bucket.alias("bucket"), "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(pdf["bucket"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64), distance)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.groupBy("pack").applyInPandas(run, "u long, v long")


def classes(prints: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """prints(doc_id, fp) -> (fp, root, component_id, members): one row per distinct fingerprint; members counts rows."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    tied = star_components(links(distinct.select("fp"), distance, split))
    rooted = distinct.join(tied.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpoint(rooted)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("members"))
    return rooted.select("fp", "root").join(checkpoint(named), "root")


def simhash_components(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fp, component_id, members."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    prints = checkpoint(with_fingerprints(src, "text", width, ["doc_id"]))
    return prints.join(classes(prints, distance, split), "fp").select("doc_id", "fp", "component_id", "members", "root")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """The row with the smallest doc_id of every class, with all columns of docs. Rows without a link are not shuffled."""
    names = docs.columns
    made = checkpoint(simhash_components(docs, width, distance))
    linked = made.where("members > 1")
    bits = membership.bits_for(linked.count())
    maybe, alone = membership.split(docs, F.col("doc_id").cast("long"), membership.bitmap(linked, F.col("doc_id"), bits), bits)
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")
    maybe = with_fingerprints(maybe.select(row, F.col("text")), "text", width, ["row"])
    root = linked.select("fp", "root").distinct()
    maybe = maybe.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id").cast("long"), F.col("row.text"))
    one = maybe.groupBy("root").agg(F.min_by("row", first).alias("row"))
    return alone.select([F.col(f"`{n}`") for n in names]).unionByName(one.select([F.col(f"row.`{n}`") for n in names]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
