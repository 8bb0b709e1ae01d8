"""Quality, language model, BPE, HTML and top-k against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, html_extraction, lm_scoring, mixing, quality, topk
from graphloom.llm.html_pages import MARK, labelled_pages
from graphloom.session import Staging

SCHEMA = "doc_id long, text string"


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op2_quality(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert len(got) == len(docs)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    m = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.97
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "x", 0.3), (2, "", 0.2), (3, "y " * 90_000, 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, none))
    assert out.columns == ["doc_id", "text", "score", "_score"] and {r["_score"] for r in out.collect()} == {0.5}
    one = spark.createDataFrame([(2, 1), (1, 1), (3, 1)], "doc_id long, quality int")
    assert quality.keep_good(docs, one).count() == 5
    assert quality.score(docs.limit(0), quality.train(docs, one)).count() == 0


def test_forest_is_its_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    f = quality.fit(x, y, trees=12, depth=3)
    slow = []
    for row in x:
        total = f.base
        for t in range(len(f.leaf)):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.threshold[t, node])
            total += f.leaf[t, node - f.feature.shape[1]]
        slow.append(1 / (1 + math.exp(-total)))
    assert np.allclose(f.score(x), slow) and ((f.score(x) >= 0.5) == y).mean() > 0.9


def brute_lm(docs):
    docs = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, (t or "").encode().lower().split() + [b"\n"]) for i, t in docs]
    c, n1, n2 = Counter(), Counter(), Counter()
    for _, held, w in docs:
        if not held:
            c.update(w)
            n1.update(zip(w, w[1:]))
            n2.update(zip(w, w[1:], w[2:]))
    n, v = sum(c.values()), len(c)
    least = lm_scoring.MIN_COUNT
    f1, f2 = Counter(k[0] for k, m in n1.items() if m == 1), Counter(k[:2] for k, m in n2.items() if m == 1)
    e = lambda f, t: (f + 0.5) / (t + 1)
    p0, o0 = lambda x: (c[x] + 1) / (n + v + 1), lambda x: max(c[x], 1) / (n + v)
    p1 = lambda a, x: (1 - e(f1[a], c[a])) * n1[a, x] / c[a] + e(f1[a], c[a]) * p0(x)
    o1 = lambda a, x: (1 - e(f1[a], c[a])) * max(n1[a, x] - 1, 0) / max(c[a] - 1, 1) + e(f1[a], c[a]) * o0(x)
    p2 = lambda a, b, x: (1 - e(f2[a, b], n1[a, b])) * n2[a, b, x] / n1[a, b] + e(f2[a, b], n1[a, b]) * p1(b, x)
    o2 = lambda a, b, x: (1 - e(f2[a, b], n1[a, b])) * max(n2[a, b, x] - 1, 0) / max(n1[a, b] - 1, 1) + e(f2[a, b], n1[a, b]) * o1(b, x)
    d1, d2 = defaultdict(float), defaultdict(float)
    for (a, x), m in n1.items():
        if c[a] >= least:
            d1[a] += m * math.log(o1(a, x) / o0(x))
    for (a, b, x), m in n2.items():
        if n1[a, b] >= least:
            d2[a, b] += m * math.log(o2(a, b, x) / o1(b, x))
    one = {a for a, d in d1.items() if d >= lm_scoring.DIVERGENCE}
    two = {k for k, d in d2.items() if d >= lm_scoring.DIVERGENCE and k[1] in one}
    assert one
    out = []
    for i, held, w in docs:
        score = 0.0
        for j, x in enumerate(w):
            if j >= 2 and (w[j - 2], w[j - 1]) in two:
                p = p2(w[j - 2], w[j - 1], x)
            else:
                p = p1(w[j - 1], x) if j and w[j - 1] in one else p0(x)
            score += math.log10(p)
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p0(x)) for x in w), score))
    return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


@pytest.mark.parametrize("hot", [lm_scoring.HOT, 2 * lm_scoring.MIN_COUNT])  # all contexts whole; some dealt by successor
def test_lm_brute(spark, sf_dir, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "CHUNK", 9000)
    monkeypatch.setattr(lm_scoring, "RANGE", 9000)
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    got = lm_scoring.op9_lm_scoring(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = brute_lm(zip(d.doc_id, d.text)).sort_values("doc_id").reset_index(drop=True)
    for column in want:
        assert np.allclose(got[column].astype(float), want[column].astype(float), rtol=1e-9, atol=1e-8), column


@pytest.mark.parametrize("n", [10**4, 4 * 10**9])
def test_lm_least_count_is_fixed(n):
    least = lm_scoring.MIN_COUNT
    packer = lm_scoring._Packer()
    packer.add(1, False, b"often word rare word")
    row = packer.batch(0).to_pylist()[0]
    blank = lm_scoring._State(row, {}, n, 4)
    of = dict(zip(lm_scoring._hashes([b"often", b"word", b"rare", b"\n"]).tolist(), (least, least, least - 1, least - 1)))
    words = np.array([of[h] for h in blank.vocab.tolist()], float)
    state = lm_scoring._State(row, {lm_scoring.WORDS: words}, n, 4)
    h = lm_scoring._hashes([b"often", b"word", b"rare", b"word", b"\n"])
    want = np.unique(lm_scoring.combine(h[[0, 1, 3]], h[[1, 2, 4]]))  # of "often" and "word", not of "rare"
    assert (state.sends[lm_scoring.PAIRS][0] == want).all()


def test_lm_hash_ranges_have_tasks_of_their_own(spark):
    with Staging(spark, "ranges") as st:
        tree = lm_scoring.Tree(spark, st, 2)
        tree.bits = 5
        keys = np.arange(32, dtype=np.uint64) << np.uint64(59)
        rows = lm_scoring._parts(0, lm_scoring.WORDS, keys, np.ones(32), 5).to_pandas()
        answer = tree._answer(spark.createDataFrame(rows, lm_scoring.SENT))
        ranges = answer.groupBy(F.input_file_name()).agg(F.count_distinct("part").alias("n")).toPandas().n.tolist()
        assert ranges == [1] * 32


def test_lm_turns_gather_their_own_contexts():
    packer = lm_scoring._Packer()
    packer.add(1, False, " ".join(f"w{i % 50} w{i % 7}" for i in range(2000)).encode())
    row = packer.batch(0).to_pylist()[0]
    answers: dict = {}
    for kind in (lm_scoring.WORDS, lm_scoring.PAIRS, lm_scoring.NOVEL_ONE):
        answers[kind] = lm_scoring._State(row, answers, 4001, 51).sends[kind][1]
    whole = lm_scoring._State(row, answers, 4001, 51).sends[lm_scoring.CONTEXTS][0]
    turns = [lm_scoring._State(row, answers, 4001, 51, lm_scoring._of_turn(4, t, 2)).sends[lm_scoring.CONTEXTS][0] for t in (0, 1)]
    assert all(len(t) < len(whole) for t in turns) and (np.sort(np.concatenate(turns)) == whole).all()


def test_lm_gains_on_held_out_texts(spark):
    got = lm_scoring.op9_lm_scoring(spark, "/root/testdata/sf0.01").toPandas()
    for held, least in ((True, 0.03), (False, 0.1)):
        some = got[got.held_out == held]
        assert some.score.sum() > (1 - least) * some.base_score.sum()  # both are negative


def test_lm_edges(spark):
    data = [(1, None), (2, ""), (None, "a b"), (3, "A\tb a"), (3, "A\tb a"), (4, "z " * 60_000)]
    got = lm_scoring.lm_scores(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [1, 1, 3, 4, 4, 60_001]
    assert lm_scoring.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring._from_planes(lm_scoring._planes(keys), np.uint64) == keys).all()
    x = rng.integers(0, 1000, 500).astype(float)
    assert (lm_scoring._unpack(lm_scoring._pack(x, lm_scoring.PAIRS), lm_scoring.PAIRS) == x).all()


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(**bpe.tables(bpe.vocabulary()))


def test_bpe_library(coder, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(3)
    parts = [*"abcdefgh'stréveml 0129\t\n\r\x0b\x0c \x85\xa0 　\x1c<|>!?.,中文字日本語😀ñß´¼Ⅷ_", "'s", "'ll", " the", "<|endoftext|>", "  ", "\n\n"]
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "x" * 48, "x" * 49, " " * 1000, "\n" * 77 + "a", "", "é" * 200]
    known = {}
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        for x, ids, want in zip(some, coder.encode_batch(some, known), t.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, x
            assert coder.decode(ids) == t.decode(want.ids, skip_special_tokens=False)


def test_bpe_long_equals_short(coder):
    words = ["tokenization", "zzzzqqqq", "antidisestablishment"]
    assert coder.merge_many([w.encode() for w in words]) == [coder.merge_long(w.encode()) for w in words]


def test_bpe_operator(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "héllo <|endoftext|> wörld", 7), (None, "x", 8)], "doc_id long, text string, ids long")
    assert bpe.encode(df, bpe.vocabulary()).columns == ["doc_id", "ids"] and bpe.round_trip(df, bpe.vocabulary()).columns == ["doc_id", "ids", "decoded"]
    twice = [r.ids for r in bpe.encode(df.union(df), bpe.vocabulary()).where("doc_id = 3").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    enc = bpe.encode(df, bpe.vocabulary())
    back = {r.doc_id: r.decoded for r in bpe.decode(enc, bpe.vocabulary()).collect()}
    assert back == {1: "", 2: "", 3: "héllo <|endoftext|> wörld", None: "x"}
    assert bpe.digests(bpe.round_trip(df.limit(0), bpe.vocabulary(), keep=["doc_id"])).count() == 0


def test_bpe_query_digests(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation(), t.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op6_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


OFF_PATH = """
import os, sys
repo, sf = sys.argv[1:]
sys.path.insert(0, repo)  # of the driver only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", os.getcwd() + "/shared").getOrCreate()
import __spark_entry__ as e
def there(batches):
    import importlib.util
    for b in batches:
        yield b
        assert importlib.util.find_spec("graphloom") is None
assert spark.range(4).mapInArrow(there, "id long").count() == 4
q = e.queries()
docs = spark.read.parquet(sf + "/documents.parquet").count()
for name in "op2_quality op3_substring_dedup op4_topk op6_bpe op8_html_extraction op9_lm_scoring op10_simhash".split():
    assert q[name](spark, sf).count() > 0, name
import corpus_pipeline as c
assert c.run(spark, sf).count() > 0
print("fine", docs)
"""


def test_workers_without_the_package(sf_dir, tmp_path):
    """Python workers that can't import this package run every operator's Python code."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "job.py").write_text(OFF_PATH)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "job.py", repo, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "fine" in done.stdout, done.stderr[-3000:]


@pytest.fixture(scope="module")
def field():
    return html_extraction.train(labelled_pages(html_extraction.PAGES, html_extraction.SEED))


def test_html_held_out(field):
    right = total = 0
    for page in labelled_pages(150, 99):
        blocks = html_extraction.leaf_blocks(page)
        texts = [html_extraction.block_text(b) for b in blocks]
        gold = [MARK in t for t in texts]
        for b in blocks:
            b.parts = [p.replace(MARK, "") for p in b.parts]
        labels = field.decode(html_extraction.features(blocks, [t.replace(MARK, "").strip() for t in texts]))
        right, total = right + sum(bool(a) == b for a, b in zip(labels, gold)), total + len(gold)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is good.</div>
<article><h1>Ttitle of   it</h1><p><b>First text, with &amp;amp; and&nbsp;more words in it.<br><p>Second <a href="x">linked</a>
text goes on here.</p></article><div class="comments"><div class="comment"><p>I like this a lot, thanks.</p></div></div>
<footer>&copy; site &middot; All of it.</footer></body></html>"""


def test_html_page(field):
    assert html_extraction.main_text(PAGE, field) == "Ttitle of it\nFirst text, with &amp; and more words in it.\nSecond linked text goes on here."
    for odd in ("", "<p", "<", "a < b", "<script>x", "</p></div>", "<!--", "<p>&am"):
        html_extraction.main_text(odd, field)


def test_html_operator(spark, field):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "", "t"), (2, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    out = html_extraction.extract(df, field)
    assert out.columns == ["page_id", "url", "text"] and sorted(len(r.text) for r in out.collect())[:2] == [0, 0]


def test_viterbi_is_best(field):
    from itertools import product

    page = labelled_pages(1, 5)[0]
    blocks = html_extraction.leaf_blocks(page)[:9]
    rows = html_extraction.features(blocks, [html_extraction.block_text(b) for b in blocks])
    w = [sum(field.weight.get(f, 0.0) for f in r) for r in rows]

    def value(labels):
        return sum(x for x, y in zip(w, labels) if y) + sum(field.pair[a][b] for a, b in zip(labels, labels[1:]))

    assert abs(value(field.decode(rows)) - max(value(y) for y in product((0, 1), repeat=len(rows)))) < 1e-9


def test_topk_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    key = ["query_id", "rank"]
    got = topk.op4_topk(spark, sf_dir).toPandas().sort_values(key).reset_index(drop=True)
    want = con.sql(topk.ORACLE).df().sort_values(key).reset_index(drop=True)
    assert len(got) == len(want) and (got[want.columns] == want).all().all()


@pytest.mark.parametrize("seed", range(20))
def test_impact_index(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 400)), int(rng.integers(1, 9))
    x = rng.integers(-200, 300, (n, d)).astype(np.int64) // (1 if seed % 3 else 64)
    ids = rng.permutation(n).astype(np.int64)
    for i, (found, score) in enumerate(topk.ImpactIndex(ids, x).search(ids[:7], x[:7], 5)):
        exact = x @ x[i]
        best = [j for j in np.lexsort((ids, -exact)) if j != i][:5]
        assert found.tolist() == ids[best].tolist() and score.tolist() == exact[best].tolist()


@pytest.mark.parametrize("scale", (1, 2**12, 2**20))
def test_impact_index_with_a_bound_from_other_blocks(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-200, 300, (900, 8)).astype(np.int64) * scale
    best = topk._Best(np.arange(40), x[:40], 5)
    for a in range(0, 900, 130):
        best.add(topk.ImpactIndex(np.arange(a, min(a + 130, 900)), x[a : a + 130]))
    for i, (found, score) in enumerate(best.found):
        exact = x @ x[i]
        want = [j for j in np.lexsort((np.arange(900), -exact)) if j != i][:5]
        assert found.tolist() == want and score.tolist() == exact[want].tolist()


def test_topk_sends_each_vector_once(spark):
    """No exchange or broadcast of queries for every block: what the plan moves must not grow with queries times blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6)).round(3)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(4000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, block=100, queries=150)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "explode" not in plan
    whole = np.floor(256 * x).astype(np.int64)
    found = got.toPandas().sort_values(["query_id", "rank"])
    assert len(found) == 400 * 5
    for i, rows in found.groupby("query_id"):
        exact = whole @ whole[i]
        want = [j for j in np.lexsort((np.arange(4000), -exact)) if j != i][:5]
        assert rows.vec_id.tolist() == want and rows.score.tolist() == exact[want].tolist()


def test_topk_edges(spark):
    data = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (1, [0.1, 0.2]), (2, None), (3, [None, 0.1]), (4, [float("nan"), 0.1]), (5, [float("inf"), 0.0]), (6, []), (7, [0.3]), (None, [0.1, 0.1]), (50, [0.5, 0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=1, queries=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mixing_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = mixing.op5_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    assert (got.taken <= 2 * got["size"]).all()


def test_mixing_edges(spark):
    data = [(i, "w " * (i % 40 + 1), f"s{i % 3}", "x") for i in range(300)] + [(i, "v " * 9, None, "x") for i in range(300, 340)] + [(900, None, "s0", "x"), (901, "", "empty", "x"), (None, "a b", "s1", "x"), (5, "w " * 6, "s2", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, row string")
    out = mixing.mixture(docs).toPandas()
    assert len(out) == len(data) and (out.taken <= 2 * out["size"]).all()
    sums = out.assign(source=out.source.fillna("~")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((sums.target - sums.taken).abs() <= 3).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == out.copies.sum()
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_mixing_empties_and_long_texts(spark):
    """No document has more copies than epochs, empty ones in a source at its maximum included."""
    data = [(i, "" if i % 2 else "w " * 5, "small") for i in range(40)] + [(100 + i, "v " * 9, "big") for i in range(400)]
    data += [(900 + i, None, "nothing") for i in range(5)] + [(1000, "u " * 300_000, "vast")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mixture(docs, weights=(1, 1, 50, 1)).toPandas()
    assert out.copies.max() <= 2 and (out.copies[out.source == "small"] == 2).all() and (out.copies[out.source == "nothing"] == 0).all()
    assert mixing.mix(docs, weights=(1, 1, 50, 1)).count() == out.copies.sum()


def test_mixing_beyond_a_very_long_document(spark):
    keys = {i: hashlib.md5(f"17:{i}".encode()).hexdigest() for i in range(2000)}
    early = sorted(keys, key=keys.get)[20]  # the long document ends the seeded prefix after twenty
    data = [(i, "w " * (20_000 if i == early else 10), "a") for i in range(2000)] + [(i, "v " * 10, "b") for i in range(2000, 2100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    options = {"weights": (1, 50), "share": 0.5}
    out = mixing.mixture(docs, **options).toPandas()
    a = out[out.source == "a"]
    assert 9000 < a.target.iloc[0] < 20_000 and abs(a.taken.sum() - a.target.iloc[0]) <= 10
    assert a.copies[a.doc_id == early].iloc[0] == 0 and a.copies.max() == 1
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == docs.columns and mixed.count() == out.copies.sum()


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in c.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert 1000 > counts[0] > counts[1] >= counts[2] and counts[3] > counts[2]


PROSE = [
    "Some prose of a kind that articles have, with commas and full stops. It goes on for a while, as prose does.",
    "Another line of prose here, which is rather long and has many words in it, so that it looks like text. And more.",
]
ARTICLE = f"<article><h1>A title of it</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p></article>"


@pytest.mark.parametrize("tag", ["nav", "form", "header", "footer", "aside"])
def test_html_prose_outside_the_article(field, tag):
    want = "\n".join(["A title of it", *PROSE])
    for inner in (f"<p>{PROSE[0]}</p>", f"<p>{PROSE[0]}</p><p>{PROSE[1]}</p>"):
        deep = "<div>" * 70
        for part in (f"<{tag}>{inner}</{tag}>", f"<{tag}>{deep}{inner}</{tag}>"):
            assert html_extraction.main_text(f"<body>{part}{ARTICLE}", field) == want
            assert html_extraction.main_text(f"<body>{ARTICLE}{part}</body>", field) == want


def test_html_math_and_noscript_stay(field):
    page = f"<article><h1>It</h1><p>Text with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in it, and more.</p><noscript><p>{PROSE[0]}</p></noscript></article>"
    assert html_extraction.main_text(page, field) == f"It\nText with x=2 in it, and more.\n{PROSE[0]}"


def test_html_deep_pages_are_linear(field):
    import time

    n = 100_000
    shapes = ["<div>" * n + "x", "<div>" * n + "</b></i>" * n + "x", "<b>" * n + "<div></div>" * n, "<div>" * n + "<td>x" * n, "<svg>" * n, "<a>" * n, "<a x='>" * n]
    for page in shapes:
        began = time.process_time()
        html_extraction.leaf_blocks(page)
        assert time.process_time() - began < 15  # quadratic reading takes minutes
    assert html_extraction.main_text("<div>" * n + f"<footer><p>{PROSE[0]}</p></footer>{ARTICLE}", field) == "\n".join(["A title of it", *PROSE])
    long = "word " * 400_000
    assert html_extraction.main_text(f"<article><p>{long}</p></article>", field) == long.strip()


class _Reader(HTMLParser):
    """An independent reading of a page's article with the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("a", "b", "i", "em", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("a", "b", "i", "em", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_query_on_the_whole_table(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = html_extraction.op8_html_extraction(spark, sf_dir).toPandas().set_index("page_id")
    assert len(got) == len(pages) and list(got.columns) == ["url", "text", "n_chars"]
    for page_id, url, page in zip(pages.page_id, pages.url, pages.html):
        reader = _Reader()
        reader.feed(page)
        want = "\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)
        assert tuple(got.loc[page_id]) == (url, want, len(want))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(empty, html_extraction.Field({}, np.zeros((2, 2)))).count() == 0
