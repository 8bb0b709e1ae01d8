"""Seeded generators of edge batches. Values come from a 31-bit congruential hash in plain arithmetic, so they are the
same at any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

MODULUS = 2147483647
ROUNDS = ((48271, 11), (69621, 7919), (16807, 104729))


def draw(i: Column, stream: int, seed: int) -> Column:
    """Integers of 0 to MODULUS - 1 for row i; stream separates draws of one row."""
    x = (i * 2654435 + F.lit(stream * 7368787 + seed * 15485863)) % MODULUS
    for a, b in ROUNDS:
        x = ((x * a + b) % MODULUS)
        x = (x * (x % 32749 + 1) + b) % MODULUS
    return x


def uniform(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """(row, src, dst): endpoints uniform over 0 .. vertices - 1; repeats and loops can occur."""
    row = spark.range(edges).select(F.col("id").alias("row"))
    return row.select("row", (draw(F.col("row"), 0, seed) % vertices).alias("src"), (draw(F.col("row"), 1, seed) % vertices).alias("dst"))


def mirrored_uniform(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """Rows 2e and 2e + 1 are an edge and its reverse."""
    e = uniform(spark, vertices, edges, seed)
    return e.select((F.col("row") * 2).alias("row"), "src", "dst").unionByName(
        e.select((F.col("row") * 2 + 1).alias("row"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )


def inverted_uniform(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """The transpose of `uniform` with the same seed."""
    return uniform(spark, vertices, edges, seed).select("row", F.col("dst").alias("src"), F.col("src").alias("dst"))


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 1, a=0.55, b=0.15, c=0.15, d=0.25, noise=0.05) -> DataFrame:
    """(row, src, dst) in 0 .. 2^scale - 1: a quadrant per bit, by weights that wobble by +-noise and are normalised."""
    unit = lambda stream: draw(F.col("row"), stream, seed) / F.lit(float(MODULUS))
    # in steps of named columns, so that a draw is made once however often it is used
    rows = spark.range(edges).select(F.col("id").alias("row"), *[unit(k).alias(f"u{k}") for k in range(scale * 5)])
    weights = [
        (F.lit(x) * (F.lit(1 - noise) + F.lit(2 * noise) * F.col(f"u{bit * 5 + k}"))).alias(f"w{bit}_{k}")
        for bit in range(scale) for k, x in enumerate((a, b, c, d))
    ]
    rows = rows.select("row", *[f"u{bit * 5 + 4}" for bit in range(scale)], *weights)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    ats = []
    for bit in range(scale):
        w = [F.col(f"w{bit}_{k}") for k in range(4)]
        ats += [(F.col(f"u{bit * 5 + 4}") * (w[0] + w[1] + w[2] + w[3])).alias(f"at{bit}"), w[0].alias(f"one{bit}")]
        ats += [(w[0] + w[1]).alias(f"two{bit}"), (w[0] + w[1] + w[2]).alias(f"three{bit}")]
        at, one, two, three = (F.col(f"{n}{bit}") for n in ("at", "one", "two", "three"))
        right = ((at >= one) & (at < two)) | (at >= three)
        src, dst = src * 2 + (at >= two).cast("long"), dst * 2 + right.cast("long")
    return rows.select("row", *ats).select("row", src.alias("src"), dst.alias("dst"))


def bucket(parts: int = 10) -> Column:
    """The bucket of an edge, the same for both directions."""
    return (F.least("src", "dst") * 31 + F.greatest("src", "dst")) % parts


def sampled_batches(graph: Graph, base: int = 8, parts: int = 10) -> tuple[Graph, list[DataFrame]]:
    """(the graph of buckets below base, one insert batch per further bucket). Each batch repeats the head of its own
    rows and holds rows of bucket 0, which are there already."""
    rest = graph.edges.where(bucket(parts) < base)
    present = graph.edges.where(bucket(parts) == 0)
    batches = []
    for k in range(base, parts):
        own = graph.edges.where(bucket(parts) == k)
        batches.append(own.unionByName(own).unionByName(present).select("src", "dst"))
    return Graph(graph.vertices, rest, graph.directed), batches


def sampler_order() -> Column:
    """The order in which `removed_batches` takes undirected edges: the same at any partitioning."""
    return (F.col("a") * 1000003 + F.col("b") * 8191) % MODULUS


def removed_batches(graph: Graph, size: int, batches: int = 5, repeats: int = 1000, present: int = 1000) -> tuple[Graph, DataFrame]:
    """(the graph without the batches' edges, rows (batch, src, dst)), to insert again: each batch is `size` undirected edges
    taken out of a symmetric graph, the first `repeats` of them once more, and `present` edges that stayed; mirrored."""
    from graphloom.plans.work import numbered

    pairs = graph.edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ranked = numbered(pairs, sampler_order(), F.col("a"), F.col("b"))
    gone = F.col("at") < batches * size
    own = ranked.where(gone).select(F.expr(f"cast(at div {size} as int)").alias("batch"), "a", "b", (F.col("at") % size).alias("k"))
    again = own.where(F.col("k") < repeats)
    which = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    there = ranked.where(~gone & (F.col("at") < batches * size + present)).select(which, "a", "b")
    rows = own.drop("k").unionByName(again.drop("k")).unionByName(there)
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    rest = ranked.where(~gone).select(F.explode(both).alias("e")).select("e.src", "e.dst")
    return Graph(graph.vertices, rest, graph.directed), rows.select("batch", F.explode(both).alias("e")).select("batch", "e.src", "e.dst")
