import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest

from graphloom.llm import secrets_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


@pytest.fixture(scope="module")
def table(spark):
    return S.train(S.labelled_samples(spark))


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in want) for k in S.KINDS[:3])


def test_whole_table(spark, sf_dir="/root/testdata/sf0.01"):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = S.op1_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sum(r.n_assign + r.n_hex for r in rows) > 0


CASES = {
    0: None, 1: "", 2: "é password = 'abcdef' x", 3: "secret:abc secret:abcdefg", 4: "password=token:abcdefgh", 5: "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
    6: "f" * 23 + " " + "0" * 24, 7: "API_KEY: 'a.b=c/d+e-f_g'", 8: "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"!", 9: "pAssWd=" + "9" * 40, 10: "x " * 20000 + "secret=abcdef",
}


def test_edges(spark, tmp_path):
    rows = [(i, t) for i, t in CASES.items()] + [(2, CASES[2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(S.op1_secret_scan(spark, str(tmp_path)).collect(), CASES)


def test_method_adds_spans(spark, table):
    texts = ["key ghp_16C7e42F292c6912E7710c838347Ae178B4a end", "the getUserAccountInformationFromDatabase call", "=" * 60, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "token=ghp_16C7e42F292c6912E7710c838347Ae178B4a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as row", "2 as t")
    out = {r.doc_id: [(x.kind, x.s, x.e) for x in r.spans] for r in S.find_secrets(df, table).collect()}
    assert out[0] == [("markov", 4, 44)] and out[1] == [] and out[2] == []
    assert [k for k, _, _ in out[3]] == ["markov"] and [k for k, _, _ in out[4]] == ["assign"]


def slow_ratio(text, table):
    last, total = 0, 0.0
    for c in text:
        code = S.SYMBOLS.find(c) + 1
        total, last = total + round(table[last * S.WIDTH + code], 6), code
    return total


def slow_spans(text, table):
    """All spans by a plain loop: base ones, and runs that overlap none of them and score high enough."""
    fixed = base(text)
    out = [(m.start(), 3, m.end(), "markov") for m in re.finditer(S.RUN, text or "") if slow_ratio(m[0], table) >= S.THRESHOLD]
    return sorted(fixed + [x for x in out if not any(a < x[2] and x[0] < b for a, _, b, _ in fixed)])


def test_table_is_counts_of_pairs(spark, table):
    seen = {True: Counter(), False: Counter()}
    for r in S.labelled_samples(spark).collect():
        codes = [0] + [S.SYMBOLS.find(c) + 1 for c in r.text]
        seen[r.secret].update(zip(codes, codes[1:]))
    for a in range(S.WIDTH):
        total = {k: sum(n for (x, _), n in c.items() if x == a) + S.SMOOTH * S.WIDTH for k, c in seen.items()}
        for b in range(S.WIDTH):
            p = {k: (c[a, b] + S.SMOOTH) / total[k] for k, c in seen.items()}
            assert abs(table[a * S.WIDTH + b] - math.log(p[True] / p[False])) < 1e-9


def test_spans_brute_and_planted(spark, table, sf_dir="/root/testdata/sf0.01"):
    """Every document against the plain loop, and again with a random string planted in each: found, and nothing else."""
    rng = random.Random(4)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    planted, place = {}, {}
    for i, t in texts.items():
        at = t.find(" ", len(t) // 2)
        at = len(t) if at < 0 else at
        alphabet = rng.choice(["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, S.SYMBOLS[:64]])
        secret = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 44)))
        planted[i], place[i] = f"{t[:at]} {secret} {t[at:]}", (at + 1, at + 1 + len(secret))
    for some in (texts, planted):
        frame = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(4)
        got = {r.doc_id: [(x.s, x["rank"], x.e, x.kind) for x in r.spans] for r in S.find_secrets(frame, table).collect()}
        assert got == {i: slow_spans(t, table) for i, t in some.items()}
    added = {i: [x for x in spans if x[3] == "markov"] for i, spans in got.items()}
    hit = sum(any(s == place[i][0] and e == place[i][1] for s, _, e, _ in got[i]) for i in got)
    false = sum(1 for i, spans in added.items() for s, _, e, _ in spans if not (s < place[i][1] and place[i][0] < e))
    assert hit / len(got) > 0.97 and false <= 2  # of some 500,000 words


def test_samples_apart(spark, table):
    """On samples the models were not trained on."""
    from pyspark.sql import functions as F

    rows = S.labelled_samples(spark, 3000, 1_000_000).select("secret", (S.ratio(F.col("text"), table) >= S.THRESHOLD).alias("hit"))
    n = {(r.secret, r.hit): r["count"] for r in rows.groupBy("secret", "hit").count().collect()}
    assert n[True, True] / 3000 > 0.9 and n.get((False, True), 0) / 3000 < 0.001


def test_empty(spark, table):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.find_secrets(df, table).count() == 0


def test_native_plan(spark, table, sf_dir):
    plan = S.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
