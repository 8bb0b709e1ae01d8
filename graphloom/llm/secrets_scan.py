"""Secret scan in DataFrame and SQL functions only: fixed patterns, and two character Markov models.

Base spans come from three patterns, each leftmost and non-overlapping per kind; a match that fails its length is
dropped after matching. The method adds spans: runs of at least MIN_RUN token characters that overlap no base span and
are likelier under a Markov model of random strings than under one of ordinary identifiers by at least
THRESHOLD nats. Both models are order-1 with a start state, trained from labelled samples by counting character pairs;
their difference is one array of (symbols + 1)^2 log ratios, so scoring needs no join and no shuffle.

Offsets are code points, end exclusive, of the whole match. Defined results: null text counts as empty, with no
spans; repeated rows repeat their result; an empty table gives an empty result; other columns, also of clashing
names, pass through `find_secrets` unless named `spans`, which it replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

MIN_RUN = 12  # characters; shorter runs hold too little evidence to tell the two models apart
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN
THRESHOLD = 20.0
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WIDTH = len(SYMBOLS) + 1  # and 0: start of the string
SMOOTH = 0.5
SAMPLES = 6000  # of each label

# Parts of ordinary identifiers.
PARTS = (
    "get set user name list item data file path load save read write open close start stop count index value table "
    "column row key map node edge graph tree query plan scan join group order filter sort limit window stream batch "
    "event time date hour minute second year month day total price amount account customer supplier region nation "
    "message error warning debug info status state config option default version release update insert delete create "
    "remove find search match replace format parse token buffer cache memory thread worker driver executor cluster "
    "session context request response header body content length type class method function module package import "
    "export public private static final string number integer double boolean array object result output input source "
    "target left right first last next previous begin end min max sum average mean example test sample http https www "
    "com org net html index page image style script button form field label text title article section information "
    "international development environment application performance responsibility understanding organization "
    "die der und ung keit schen lich le la les que ment eau tion de el los ado ciones mente entre para"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """(text, secret): seeded random strings over usual alphabets, and identifiers and numbers of usual conventions.

    n of each label; other values of first give other samples, as for held-out ones.
    """
    rows = spark.range(first, first + n, 1, 4).withColumn("d", F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 512))
    raw = F.base64(F.unhex("d"))
    length = F.lit(MIN_RUN) + F.pmod(F.col("id") * 7, F.lit(36))
    letters = F.regexp_replace(raw, "[+/=]", "")
    shapes = [raw, letters, letters, F.col("d"), F.upper("d"), F.translate(F.upper("d"), "01", "YZ")]
    random = F.element_at(F.array(*[F.substring(x, F.lit(1), length.cast("int")) for x in shapes]), (F.pmod("id", F.lit(len(shapes))) + 1).cast("int"))
    secret = rows.select(random.alias("text"), F.lit(True).alias("secret"))

    words = F.array(*[F.lit(p) for p in PARTS])
    some = F.transform(
        F.sequence(F.lit(1), (F.pmod("id", F.lit(5)) + 3).cast("int")),
        lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(PARTS))) + 1).cast("int")),
    )
    camel = F.regexp_replace(F.initcap(F.concat_ws(" ", some)), " ", "")
    digits = F.translate("d", "abcdef", "271828")
    forms = [
        F.substring(F.lit(SYMBOLS), F.pmod("id", F.lit(36)).cast("int") + 1, F.lit(26)),
        F.substring(digits, F.lit(1), (F.pmod(F.col("id") * 5, F.lit(20)) + 8).cast("int")),
        F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4)),
        F.concat_ws("_", some), F.concat_ws("-", some), camel, F.upper(F.concat_ws("_", some)), F.concat_ws("/", some),
        F.concat_ws("", some), F.concat(F.concat_ws("_", some), F.lit("_"), F.pmod(F.xxhash64("id"), F.lit(2030)).cast("string")),
        F.repeat(F.substring(F.lit(SYMBOLS), (F.pmod(F.xxhash64("id"), F.lit(len(SYMBOLS))) + 1).cast("int"), F.lit(1)), 32),
        F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 86_461), "yyyy-MM-dd'T'HH-mm-ss-SSSSSS"),
    ]
    plain = F.element_at(F.array(*forms), (F.pmod("id", F.lit(len(forms))) + 1).cast("int"))
    return secret.unionByName(rows.select(plain.alias("text"), F.lit(False).alias("secret")))


def train(samples: DataFrame) -> list[float]:
    """Log ratios log P(b | a, random) / P(b | a, identifier) at place a * WIDTH + b, from samples(text, secret).

    At most 2 * WIDTH^2 counts reach the driver, whatever the number of samples. Characters outside SYMBOLS count as 0.
    """
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    rows = samples.where("text is not null and text <> ''").select("secret", F.concat(F.array(F.lit(0)), codes).alias("c"))
    pairs = rows.select("secret", F.explode(F.expr("zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> named_struct('a', a, 'b', b))")).alias("p"))
    counts = pairs.groupBy("secret", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    seen = {True: [0.0] * WIDTH**2, False: [0.0] * WIDTH**2}
    for r in counts:
        seen[bool(r.secret)][r.a * WIDTH + r.b] += r["count"]
    table = []
    for a in range(WIDTH):
        rows_of = {k: v[a * WIDTH : (a + 1) * WIDTH] for k, v in seen.items()}
        total = {k: sum(v) + SMOOTH * WIDTH for k, v in rows_of.items()}
        table += [math.log((rows_of[True][b] + SMOOTH) / total[True] * total[False] / (rows_of[False][b] + SMOOTH)) for b in range(WIDTH)]
    return table


def _located(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, pieces between them); pieces only where there is a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found, F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _places(found: str, pieces: str) -> Column:
    """array<struct<s, e, m>> of matches, from them and the pieces between them."""
    return F.expr(f"""
      if(size({found}) = 0, cast(array() as array<struct<s:int,e:int,m:string>>), aggregate(
        zip_with({found}, slice({pieces}, 1, size({found})), (m, p) -> named_struct('m', m, 'p', p)),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)),
        (acc, x) -> named_struct('at', acc.at + length(x.p) + length(x.m), 'out', concat(acc.out, array(
          named_struct('s', acc.at + length(x.p), 'e', acc.at + length(x.p) + length(x.m), 'm', x.m)))),
        acc -> acc.out))""")


def ratio(run: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string: the sum of the table over its character pairs, from the start state on."""
    array = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    return F.aggregate(
        F.split(run, ""), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.element_at(array, acc["last"] * WIDTH + F.instr(F.lit(SYMBOLS), c) + 1)).alias("sum"),
            F.instr(F.lit(SYMBOLS), c).alias("last"),
        ),
        lambda acc: acc["sum"],
    )


def find_secrets(df: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df's columns and spans: array<struct<s, rank, e, kind>>, sorted by start, then kind as in KINDS."""
    names = [n for n in df.columns if n != "spans"]
    step = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    longer = {"assign": ASSIGN, "access": ACCESS, "hex": HEX.replace("+", "{%d,}" % LEAST["hex"]), "markov": RUN}
    for kind, pattern in longer.items():
        step = step.withColumn(f"f_{kind}", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    for kind, pattern in longer.items():
        step = step.withColumn(f"p_{kind}", F.when(F.size(f"f_{kind}") > 0, F.split("t", pattern, -1)))
    for kind in KINDS:
        step = step.withColumn(f"l_{kind}", _places(f"f_{kind}", f"p_{kind}"))
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2))
    step = step.withColumn("l_assign", F.filter("l_assign", lambda x: value(x) >= LEAST["assign"]))
    step = step.withColumn("l_access", F.filter("l_access", lambda x: F.length(x["m"]) >= LEAST["access"]))
    span = lambda kind: lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"))
    step = step.withColumn("base", F.concat(*[F.transform(f"l_{k}", span(k)) for k in KINDS[:3]]))
    clear = F.filter("l_markov", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    added = F.filter(clear, lambda x: ratio(x["m"], table) >= threshold)
    step = step.withColumn("spans", F.array_sort(F.concat("base", F.transform(added, span("markov")))))
    return step.select(*[F.col(f"row.`{n}`") for n in names], "spans")


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, train(labelled_samples(spark))).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("markov").alias("n_markov"),
    )
