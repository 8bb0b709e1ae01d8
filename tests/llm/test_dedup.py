"""Exact, near and paragraph duplicates against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup as E
from graphloom.llm import simhash as H
from graphloom.llm import substring_dedup as P

SCHEMA = "doc_id long, text string"


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def tie(self, a, b):
        self.up[self.find(a)] = self.find(b)


def rows(df, by="doc_id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def test_exact_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got, want = rows(E.op7_exact_dedup(spark, sf_dir)), con.sql(E.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()


def test_exact_collisions_and_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weak = rows(E.exact_dedup(docs, digest=lambda n: F.crc32(n) % 7, batch_files=2))
    assert (weak == rows(E.exact_dedup(docs))[weak.columns]).all().all()


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "ab"), (5, "ab"), (6, "a  b "), (None, "ab"), (7, "x" * 100_000), (8, "x" * 100_000 + " "), (9, "A b")]


def test_exact_edges(spark):
    got = E.exact_dedup(spark.createDataFrame(EDGE, SCHEMA)).collect()
    by = {(r.doc_id, r.points): r for r in got}
    assert len(got) == len(EDGE)
    assert by[3, 3].kept and by[1, 0].keep_id == 3 and by[1, 0].group_size == 3
    assert by[6, 5].kept and by[4, 3].keep_id == 6 and by[None, 2].keep_id == 6 and by[6, 5].group_size == 5
    assert by[8, 100_001].kept and not by[7, 100_000].kept and by[9, 3].kept
    twins = E.exact_dedup(spark.createDataFrame([(5, "ab"), (5, "ab"), (None, "zz")], SCHEMA)).collect()
    assert Counter((r.doc_id, r.kept) for r in twins) == {(5, True): 1, (5, False): 1, (None, True): 1}
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = E.drop_copies(docs)
    want = {r.doc_id for r in E.exact_dedup(docs).where("kept").collect()}
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(want)
    odd = spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "1 as row", "'x' as k_id", "2 as digest")
    assert E.drop_copies(odd).count() == 4 and E.drop_copies(odd).columns == odd.columns


CLASH = "b p bm_h bm_at bm_bucket bm_hit bm_map row key gone locator at".split()


def clashing(spark, data):
    """data with columns named like what the operators use on the way, and a map."""
    extra = [f"concat('{n}', coalesce(text, '')) as `{n}`" for n in CLASH]
    return spark.createDataFrame(data, SCHEMA).selectExpr("*", *extra, "map('k', doc_id) as m")


def unharmed(frame):
    got = frame.collect()
    assert frame.columns == ["doc_id", "text", *CLASH, "m"]
    assert all(r[n] == n + (r.text or "") and r.m == {"k": r.doc_id} for r in got for n in CLASH)
    return got


def test_split_keeps_clashing_columns(spark):
    from graphloom.llm import membership

    frame = clashing(spark, [(i, f"t{i}") for i in range(200)])
    keys = spark.range(0, 200, 7).select(F.col("id").alias("doc_id"))
    for bits in (membership.BITS, membership.bits_for(29)):
        maybe, rest = membership.split(frame, F.col("doc_id"), membership.bitmap(keys, F.col("doc_id"), bits), bits)
        a, b = unharmed(maybe), unharmed(rest)
        assert len(a) + len(b) == 200 and {r.doc_id for r in a} >= set(range(0, 200, 7)) and len(a) < 40
    assert membership.bits_for(0) == membership.LEAST_BITS and membership.bits_for(10**12) == membership.MOST_BITS


def test_stages_keep_clashing_columns(spark):
    assert {r.doc_id for r in unharmed(E.drop_copies(clashing(spark, EDGE)))} >= {3, 6, 8, 9}
    assert {r.doc_id for r in unharmed(H.drop_near_copies(clashing(spark, EDGE)))} == {1, 4, 5, 7}
    long = " ".join(f"w{i}" for i in range(40))
    out = P.remove_repeats(clashing(spark, [(1, long), (2, f"{long}\nx"), (3, "y"), (4, None)]))
    assert out.columns == ["doc_id", "text", *CLASH, "m"]
    assert {r.doc_id: (r.text, r.b) for r in out.collect()} == {1: (long, "b" + long), 2: ("x", f"b{long}\nx"), 3: ("y", "by"), 4: (None, "b")}


def test_remove_repeats_shared_ids(spark):
    """Rows that share a doc_id, or are the same throughout, lose their own removals only; one occurrence of all stays."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    data = [(1, f"x\n{one}"), (2, f"own text of two\n{two}"), (2, one), (2, one), (None, one), (None, two), (3, "z " * 300_000)]
    out = Counter((r.doc_id, r.text) for r in P.remove_repeats(spark.createDataFrame(data, SCHEMA)).collect())
    assert out == {(1, f"x\n{one}"): 1, (2, f"own text of two\n{two}"): 1, (2, ""): 2, (None, ""): 2, (3, "z " * 300_000): 1}
    assert P.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    got = P.repeated_paragraphs(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == {(1, True): 1, (2, True): 1, (2, False): 2, (None, False): 2}


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    c = Classes()
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                c.tie(i, j)
    least = {}
    for i, d in enumerate(ids):
        k = c.find(i)
        least[k] = min(least.get(k, d), d)
    return [least[c.find(i)] for i in range(len(ids))]


def test_simhash_brute(spark, sf_dir):
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = rows(H.op10_simhash(spark, sf_dir))
    prints = [slow_fingerprint(t) for t in d.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == brute_components(d.doc_id.tolist(), prints)
    split = H.simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), split=4)
    assert rows(split).component_id.tolist() == got.component_id.tolist()


@pytest.mark.parametrize("seed", range(6))
def test_gray_index(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, 30).astype(np.uint64)[rng.integers(0, 30, 900)]
    for _ in range(seed + 1):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    x = np.unique(x)
    bucket = np.sort(rng.integers(0, 4, len(x)))
    u, v = H.forest(bucket, x.view(np.int64))
    a, b = Classes(), Classes()
    for p, q in zip(u.tolist(), v.tolist()):
        a.tie(p, q)
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4) & (bucket[:, None] == bucket[None, :])
    for i, j in zip(*np.nonzero(near)):
        b.tie(int(x.view(np.int64)[i]), int(x.view(np.int64)[j]))
    groups = lambda c: sorted(sorted(g) for g in _groups(c, x.view(np.int64).tolist()))
    assert groups(a) == groups(b)


def _groups(c, items):
    out = defaultdict(list)
    for i in items:
        out[c.find(i)].append(i)
    return out.values()


def test_blocks_of_bits():
    for m in (5, 6, 7, 8):
        some = [k & (2**64 - 1) for k in H.masks(m, 4)]
        bits = [1 << b for b in (0, 17, 33, 63)]
        assert any(not any(k & b for b in bits) for k in some)


def test_simhash_edges(spark):
    data = [(1, None), (2, ""), (3, " "), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (6, "w " * 50_000)]
    got = H.simhash_components(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id in (4, 5, None)} == {4}
    assert H.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = H.drop_near_copies(spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as row", "2 as fp", "3 as root"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6] and kept.columns == ["doc_id", "text", "row", "fp", "root"]


def brute_paragraphs(docs):
    found, c, inv = [], Classes(), defaultdict(list)
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().lower().split())
            if len(w) >= P.MIN_WORDS:
                found.append((i, k, frozenset(w[a : a + 5] for a in range(len(w) - 4))))
    for x, (_, _, s) in enumerate(found):
        both = Counter(y for g in s for y in inv[g])
        for y, n in both.items():
            if n >= 0.8 * (len(s) + len(found[y][2]) - n) - 1e-9:
                c.tie(x, y)
        for g in s:
            inv[g].append(x)
    out = []
    for g in _groups(c, range(len(found))):
        if len(g) > 1:
            first = min(found[x][:2] for x in g)
            out += [(*found[x][:2], *first, len(g), found[x][:2] == first) for x in g]
    return sorted(out)


def test_paragraphs_brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_paragraphs(sorted(texts.items()))
    for split in (P.SPLIT, 4):
        got = P.repeated_paragraphs(docs, split=split).collect()
        assert sorted((r.doc_id, r.paragraph, r.keep_id, r.keep_paragraph, r.class_size, r.kept) for r in got) == want
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.paragraph] for r in got)


def test_remove_repeats(spark):
    long = " ".join(f"wörd{i}" for i in range(60))
    near = long.replace("wörd30", "other")
    data = [(1, f"a\n{long}\nb", 7), (2, f"{near}\nc", 8), (3, None, 9), (4, "", 1), (5, "short line\nshort line", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, gone long")
    out = {r.doc_id: r.text for r in P.remove_repeats(docs).collect()}
    assert out == {1: f"a\n{long}\nb", 2: "c", 3: None, 4: "", 5: "short line\nshort line"}
    assert P.repeated_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_inside_lines_and_rewrapped(spark):
    own = lambda tag, n: " ".join(f"{tag}{i}é" for i in range(n))
    words = [f"Word{i}ö" for i in range(60)]
    passage, edited = " ".join(words), " ".join([*words[:30], "other", *words[31:]])
    wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, 60, 7))
    data = [(1, f"{own('a', 90)} {passage} {own('b', 90)}"), (2, f"{own('c', 3)}\n{own('d', 200)} {passage.lower()} {own('e', 40)}"),
            (3, f"{own('f', 30)}\n{wrapped}\n{own('g', 5)}"), (4, f"{own('h', 80)} {edited} {own('i', 80)}"),
            (5, own("j", 300)), (6, own("k", 10)), (7, None), (None, f"{own('l', 80)} {passage}")]
    texts = dict(data)
    docs = spark.createDataFrame(data, SCHEMA)
    assert P.repeated_paragraphs(docs).count() == 0
    got = P.repeated_text(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, None}
    low = passage.lower()
    for r in got:
        part = " ".join(texts[r.doc_id][r.start : r.end].lower().split())
        assert part in (edited.lower() if r.doc_id == 4 else low) and len(part.split()) == r.n_words and r.keep_id == 1 and r.kept == (r.doc_id == 1) and r.keep_paragraph == 0
        assert r.paragraph == texts[r.doc_id][: r.start].count("\n")
    covered = Counter()
    for r in got:
        covered[r.doc_id] += r.n_words
    assert all(covered[i] >= 50 for i in (1, 2, 3, None)) and covered[4] >= 40
    assert P.repeated_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_21_words_share_a_choice(seed):
    from graphloom.llm import passages as W

    rng = np.random.default_rng(seed)
    run = rng.integers(0, 2**63, W.GRAM + W.WINDOW - 1).astype(np.uint64)
    keys = []
    for n in rng.integers(0, 40, 4):
        h = np.r_[rng.integers(0, 2**63, n).astype(np.uint64), run, rng.integers(0, 2**63, n // 2).astype(np.uint64)]
        g = W._rolled(h, W.FACTORS[0])
        keys.append(set(g[W.chosen(g)].tolist()))
    assert set.intersection(*keys)


def test_words_as_arrays():
    from graphloom.llm.text import Words

    texts = ["", "Ab aB\tab\n\nÉ É é", "\n \x0b ", f"{'y' * 999} {'Y' * 999} {'y' * 998}z", "abcdefgh abcdefghi abcdefghI abcdefg", "x" * 256 + " " + "x" * 257, "a\x00 a"]
    words = Words([t.encode() for t in texts])
    of = {}
    points = words.points()
    for i, t in enumerate(texts):
        a, b = words.word[i], words.word[i + 1]
        assert [words.low[x:y].tobytes() for x, y in zip(words.start[a:b], words.end[a:b])] == t.encode().lower().split()
        base = points[words.first[i]]
        assert [t[points[x] - base : points[y] - base] for x, y in zip(words.start[a:b], words.end[a:b])] == [w.decode() for w in t.encode().split()]
        for w, h in zip(t.encode().lower().split(), words.hash[a:b].tolist()):
            assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    assert len(Words([]).hash) == len(Words([b""]).hash) == 0


def test_runs_are_chosen_in_each_text_as_alone():
    from graphloom.llm import passages as W
    from graphloom.llm.text import Words

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)).encode() for n in (0, 15, 16, 18, 21, 22, 40, 0, 200, 17)]
    keys, at = W.runs(words := Words(texts))
    for i, t in enumerate(texts):
        alone_keys, alone = W.runs(Words([t]))
        mine = words.of[at] == i
        assert (at[mine] - words.word[i] == alone).all() and (keys[mine] == alone_keys).all() and bool(len(alone)) == (len(t.split()) >= W.GRAM)
