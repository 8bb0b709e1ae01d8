"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Water-filling: all sources share a budget of words by weight; a source whose share is above its maximum epochs is
clamped there and the excess is shared again by weight, until none is above. A round needs three sums over the
source table, so any number of sources works.

Sampling: a source with target t and size s takes every document floor(t / s) times, and the rest of its target in
the seeded order of md5(seed:doc_id): documents are taken once more up to the last that fits, then at most `fill`
documents, each the one that leaves the smallest gap, close it (only the last may pass the target). A source that this
leaves more than NEAR mean documents off its target (very long documents end its prefix early) is taken further instead:
documents that do not fit are set aside, and passes over those of at most half the gap, in the seeded order, halve it
until no document fits; then one may pass the target if that is nearer. Documents are always taken whole. Prefix sums are made
in two levels (16^digits hash ranges a source, then one range), so a source with a third of all rows is no task's burden.

Defined results: null text has size 0 (a source of such texts only has target 0 and is left out); null is a source of its own, ordered last; null doc_ids are hashed as ''; rows
that repeat source and doc_id are taken or left together; an empty table gives an empty result; other columns, also
of clashing names, pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import membership
from graphloom.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 17
FILL = 3
DIGITS = 3  # hash digits of a range
NEAR = 3  # mean documents of the source; the SQL leaves up to 2.3 on sf0.001 (src19), so less would depart from it there
BROADCAST_SOURCES = 20_000  # rows of the per-source table (a few hundred bytes each) that may be broadcast


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, size) -> source, size, weight, target (double). One row per source."""
    # one row a source meets in this window; documents never do
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    src = sizes.withColumn("weight", F.element_at(table, (rank % len(weights) + 1).cast("int")))
    src = checkpoint(src)
    total, weight = src.agg(F.sum("size"), F.sum("weight")).first()
    if not weight:
        return src.withColumn("target", F.lit(0.0))
    level = share * total / weight
    while True:  # the clamped set only grows, so this ends
        clamped = src.where(F.col("weight") * level > epochs * F.col("size"))
        caps, taken = clamped.agg(F.coalesce(F.sum("size"), F.lit(0)) * epochs, F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        again = (share * total - caps) / (weight - taken) if weight > taken else level
        if again == level:
            break
        level = again
    return src.withColumn("target", F.least(F.col("weight") * level, F.col("size").cast("double") * epochs))


def _prefix(units: DataFrame, t: DataFrame, digits: int) -> DataFrame:
    """t(t_source, rest, ...) with where the seeded prefix of each source ends: part, before, and last, its last unit."""
    part = F.substring("key", 1, digits).alias("part")
    parts = units.groupBy("source", part).agg(F.sum("size").alias("size"))
    w = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = (
        parts.join(t, F.col("source").eqNullSafe(F.col("t_source"))).where("upto > rest")
        .groupBy("t_source").agg(F.min(F.struct("part", (F.col("upto") - F.col("size")).alias("before"))).alias("at"))
        .select(F.col("t_source").alias("c_source"), "at.part", "at.before")
    )
    cut = t.join(cut, F.col("t_source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    cut = checkpoint(cut.withColumn("part", F.coalesce("part", F.lit("~"))).withColumn("before", F.coalesce("before", F.lit(0))))
    near = cut.select("t_source", "part", "before", "rest")
    inside = units.join(near, F.col("source").eqNullSafe(F.col("t_source")) & (F.substring("key", 1, digits) == F.col("part")))
    w = Window.partitionBy("t_source").orderBy("key", "doc_id")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where("upto <= rest").groupBy("t_source").agg(F.max(F.struct("key", "doc_id", "upto")).alias("last"))
    last = last.select(F.col("t_source").alias("l_source"), "last")
    return cut.join(last, F.col("t_source").eqNullSafe(F.col("l_source")), "left")


def plan(units: DataFrame, targets: DataFrame, fill: int = FILL, digits: int = 3) -> DataFrame:
    """Per source: whole (copies of all), cut_key and cut_id (last taken once more), extra (array of further units).

    units(source, doc_id, key, size): one row per source and doc_id.
    """
    size = F.col("source_size").cast("double")
    t = targets.select(
        F.col("source").alias("t_source"), F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size").cast("double"))).otherwise(0).cast("int").alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * size)
    t = checkpoint(t)
    cut = _prefix(units, t, digits)
    none = F.expr("cast(array() as array<struct<key:string,doc_id:bigint>>)")
    cut = cut.select(
        "t_source", "source_size", "target", "whole", F.col("rest").alias("fraction"),
        F.coalesce("last.key", "part").alias("cut_key"), F.col("last.doc_id").alias("cut_id"),
        (F.col("rest") - F.coalesce("last.upto", "before")).alias("gap"), none.alias("extra"),
    ).withColumn("prefix_gap", F.col("gap"))
    for n in range(fill):
        cut = checkpoint(cut)
        limit = "size <= gap" if n < fill - 1 else "size < 2 * gap"  # only the last may pass the target
        fits = _with_plan(units, cut).where(f"size > 0 AND {limit}").where(~taken_again())
        best = fits.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "key", "doc_id", "size")).alias("best"))
        best = best.select(F.col("source").alias("b_source"), "best")
        cut = cut.join(best, F.col("t_source").eqNullSafe(F.col("b_source")), "left").select(
            "t_source", "source_size", "target", "whole", "fraction", "cut_key", "cut_id", "prefix_gap",
            (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"),
            F.when(F.col("best").isNull(), F.col("extra"))
            .otherwise(F.concat("extra", F.array(F.struct("best.key", "best.doc_id")))).alias("extra"),
        )
    return checkpoint(cut)


def taken_again() -> Column:
    """Over a row with key, doc_id and its source's plan: is it in the fractional repetition? Not even an empty document is
    in one of nothing, so none has more copies than the maximum of epochs."""
    id_in = F.col("doc_id").isNull() | (F.col("cut_id").isNotNull() & (F.col("doc_id") <= F.col("cut_id")))
    prefix = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & F.coalesce(id_in, F.lit(False)))
    return (F.col("fraction") > 0) & (prefix | F.array_contains("extra", F.struct("key", "doc_id")))


def further(units: DataFrame, cut: DataFrame, digits: int) -> tuple[DataFrame, DataFrame | None]:
    """(plan, units(m_source, m_id) taken once more beyond the prefix) where sources are far off their targets, else None."""
    means = units.where("size > 0").groupBy(F.col("source").alias("u_source")).agg(F.avg("size").alias("mean"))
    far = cut.where("gap <> 0").join(means, F.col("t_source").eqNullSafe(F.col("u_source"))).where(F.abs("gap") > NEAR * F.col("mean"))
    far = checkpoint(far.select("t_source", F.col("prefix_gap").alias("rest"), F.col("gap").alias("was")))
    if far.isEmpty():
        return cut, None
    same = F.col("source").eqNullSafe(F.col("t_source"))
    only = F.expr("cast(array() as array<struct<key:string,doc_id:bigint>>)")
    left = _with_plan(units, cut.withColumn("extra", only)).where("size > 0").where(~taken_again()).select(units.columns)
    left = checkpoint(left.join(far.select("t_source"), same, "left_semi"))
    states, took, more = far, [], True
    while more:  # the gap of a source halves in each round, or no unit of half the gap is left
        state = states.select("t_source", "rest")
        fits = checkpoint(left.join(state, same).where("size <= rest"))
        more = not fits.isEmpty()
        if more:
            halves = fits.where("2 * size <= rest").select(units.columns)
            ends = _prefix(halves, state, digits).select(
                F.col("t_source").alias("e_source"), F.coalesce("last.key", "part").alias("cut_key"), F.col("last.doc_id").alias("cut_id"), only.alias("extra"),
                F.lit(1.0).alias("fraction"),
            )
            now = halves.join(ends, F.col("source").eqNullSafe(F.col("e_source"))).where(taken_again()).select(units.columns)
            some = halves.select(F.col("source").alias("h_source")).distinct()
            best = fits.join(some, F.col("source").eqNullSafe(F.col("h_source")), "left_anti")  # all are over half the gap: one fits
        else:
            best, now = left.join(state, same).where("size < 2 * rest"), None
        best = best.groupBy("source").agg(F.min(F.struct(F.abs(F.col("rest") - F.col("size")).alias("off"), "key", "doc_id", "size")).alias("best"))
        best = best.select("source", "best.doc_id", "best.key", "best.size")
        now = checkpoint(best if now is None else now.unionByName(best))
        took.append(now)
        sums = now.groupBy(F.col("source").alias("n_source")).agg(F.sum("size").alias("sum"))
        states = checkpoint(states.join(sums, F.col("t_source").eqNullSafe(F.col("n_source")), "left").select(
            "t_source", (F.col("rest") - F.coalesce("sum", F.lit(0))).alias("rest"), "was"))
        ids = now.select(F.col("source").alias("n_source"), F.col("doc_id").alias("n_id"))
        left = checkpoint(left.join(ids, F.col("source").eqNullSafe(F.col("n_source")) & F.col("doc_id").eqNullSafe(F.col("n_id")), "left_anti"))
    better = states.where(F.abs("rest") < F.abs("was")).select(F.col("t_source").alias("b_source"), "rest")
    better = checkpoint(better)
    every = took[0]
    for x in took[1:]:
        every = every.unionByName(x)
    every = every.join(better, F.col("source").eqNullSafe(F.col("b_source")), "left_semi")
    cut = cut.join(better, F.col("t_source").eqNullSafe(F.col("b_source")), "left")
    on = F.col("rest").isNotNull()
    cut = cut.withColumn("extra", F.when(on, only).otherwise(F.col("extra"))).withColumn("gap", F.coalesce("rest", "gap")).drop("b_source", "rest")
    return checkpoint(cut), checkpoint(every.select(F.col("source").alias("m_source"), F.col("doc_id").alias("m_id")))


def _copies(rows: DataFrame, cut: DataFrame, more: DataFrame | None) -> DataFrame:
    """rows(source, doc_id, key, ...) with their plan and copies."""
    out = _with_plan(rows, cut).withColumn("copies", F.col("whole") + taken_again().cast("int"))
    if more is None:
        return out
    also = F.col("source").eqNullSafe(F.col("m_source")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    more = more.withColumn("also", F.lit(1))
    maybe, rest = membership.split(out, F.struct("source", "doc_id"), membership.bitmap(more, F.struct("m_source", "m_id")))
    maybe = maybe.join(more, also, "left").withColumn("copies", F.col("copies") + F.coalesce("also", F.lit(0)))
    return maybe.select(out.columns).unionByName(rest)


def _with_plan(rows: DataFrame, cut: DataFrame) -> DataFrame:
    small = cut.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(cut) if small else cut, F.col("source").eqNullSafe(F.col("t_source")))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, seed=SEED, fill=FILL) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(per-document narrow rows: doc_id, source, key, size; per-source plan; units of `further`)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        order_key(F.col("doc_id").cast("long"), seed).alias("key"), word_count(F.col("text")).alias("size"),
    )
    rows = checkpoint(rows)
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, epochs)
    units = rows.groupBy("source", "doc_id", "key").agg(F.sum("size").alias("size"))
    units = checkpoint(units)
    digits = DIGITS if units.count() < 4_000_000_000 else DIGITS + 1
    return rows, *further(units, plan(units, targets, fill, digits), digits)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source, copies."""
    out = _copies(*mix_plan(docs, **options))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixed rows of docs with all their columns: a document appears as often as it is taken."""
    _, cut, more = mix_plan(docs, seed=seed, **options)
    names = docs.columns
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("source").cast("string").alias("source"),
        doc_id.alias("doc_id"), order_key(doc_id, seed).alias("key"),
    )
    out = _copies(rows, cut, more)
    out = out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.select([F.col(f"row.`{n}`") for n in names])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


# One step of the fill, over the units not yet taken; unrolled FILL times below.
_STEP = """
f{n} AS (
  SELECT source, min(row(abs(gap - size), key, doc_id, size)) AS best FROM (
    SELECT u.source, u.size, u.key, u.doc_id, g.gap FROM rest{p} u JOIN gap{p} g ON u.source IS NOT DISTINCT FROM g.source
    WHERE u.size > 0 AND u.size {limit})
  GROUP BY source),
b{n} AS (SELECT source, best[2] AS key, best[3] AS doc_id, best[4] AS size FROM f{n}),
gap{n} AS (SELECT g.source, g.gap - coalesce(b.size, 0) AS gap FROM gap{p} g LEFT JOIN b{n} b ON b.source IS NOT DISTINCT FROM g.source),
rest{n} AS (SELECT u.* FROM rest{p} u LEFT JOIN b{n} b ON b.source IS NOT DISTINCT FROM u.source AND b.key = u.key
  AND b.doc_id IS NOT DISTINCT FROM u.doc_id WHERE b.key IS NULL)"""

ORACLE = (
    r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, sum(2 * size) OVER q - 2 * size AS caps, sum(weight) OVER () - sum(weight) OVER q + weight AS left_weight
      FROM w WINDOW q AS (ORDER BY 2 * size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT CAST(1.5 * (SELECT sum(size) FROM s) - caps AS DOUBLE) / left_weight AS level, 2 * size / weight AS ratio FROM r),
v AS (SELECT max(level) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, size AS source_size, least(weight * level, 2 * CAST(size AS DOUBLE)) AS target FROM w, v),
p AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS MATERIALIZED (
  SELECT d.*, source_size, target, whole, target - whole * CAST(source_size AS DOUBLE) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source),
gap0 AS (SELECT source, min(rest) - coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS gap FROM c GROUP BY source),
rest0 AS (SELECT source, size, key, doc_id FROM c WHERE upto > rest),"""
    + ",".join(_STEP.format(n=i + 1, p=i, limit="<= g.gap" if i < FILL - 1 else "< 2 * g.gap") for i in range(FILL))
    + f"""
SELECT c.doc_id, c.size, c.source_size, c.target,
       CAST(c.size * (c.whole + CASE WHEN u.key IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN rest{FILL} u ON u.source IS NOT DISTINCT FROM c.source AND u.key = c.key AND u.doc_id IS NOT DISTINCT FROM c.doc_id
"""
)
