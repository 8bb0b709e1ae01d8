"""The pipeline's rows against a plain version of its five stages, and its edges."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from test_dedup import brute_components, slow_fingerprint

import corpus_pipeline
from graphloom.llm import bpe, mixing, quality


def plain(spark, sf_dir, folder):
    """Expected (doc_id, source, n_tokens, ids_sha256, decoded_sha256) with their numbers."""
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    forest = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = docs[forest.score(np.array([quality.statistics((t or "").encode()) for t in docs.text])) >= 0.5]
    best = {}
    for i, t in zip(docs.doc_id, docs.text):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = max(best.get(key, (-1, 0)), (len(t or ""), -i))
    docs = docs[docs.doc_id.isin({-i for _, i in best.values()})]
    docs = docs[docs.doc_id.to_numpy() == np.array(brute_components(docs.doc_id.tolist(), [slow_fingerprint(t) for t in docs.text]))]
    docs.to_parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    copies = {i: t // s for i, s, t in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall() if s}
    coder = Tokenizer.from_file(bpe.vocabulary())
    out = Counter()
    for i, source, t in zip(docs.doc_id, docs.source, docs.text):
        ids = coder.encode(t, add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        if copies[i]:
            out[i, source, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(coder.decode(ids, skip_special_tokens=False).encode())] += copies[i]
    return out


def test_run_is_its_plain_version(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = plain(spark, sf_dir, tmp_path)
    assert Counter(map(tuple, got)) == want and len(want) > 50


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows and clashing columns pass through all stages."""
    data = [(1, None, "en", "a", None), (None, "x y z", None, None, 5), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "word " * 100_000, "en", "b", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'r' as row", "'b' as b", "'i' as ids", "map('k', 1) as m")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name != "bpe":
                assert out.columns == docs.columns
                assert all((r.row, r.b, r.ids, r.m) == ("r", "b", "i", {"k": 1}) for r in out.collect())
            assert out.count() <= 2 * len(data)
    ids = {r.doc_id: r.n_tokens for r in corpus_pipeline.bpe_stage(spark, docs, sf_dir).collect()}
    assert ids[1] == ids[2] == 0 and ids[3] >= 100_000 and ids[None] > 0
