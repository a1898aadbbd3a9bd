"""The stored index and BM25 with block bounds, against plain sums over all documents."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import lexical


def documents(seed, n=400, words=30):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(words)]
    skew = [1 / (i + 1) for i in range(words)]
    out = [(i * 3, r.choices(vocabulary, skew, k=r.choice([1, 5, 40, 200]))) for i in range(n)]
    return [*out, (5000, []), (5001, None), (5002, out[7][1]), (5003, out[7][1])]


def ranking(docs, queries, k, k1, b, weights=None):
    length = {d: len(t or []) for d, t in docs}
    tf = {d: collections.Counter() for d, _ in docs}
    for d, t in docs:
        for i, x in enumerate(t or []):
            tf[d][x] += weights[d][i] if weights else 1.0
    average = sum(length.values()) / len(docs)
    df = collections.Counter(x for c in tf.values() for x in c)
    out = set()
    for q, terms in queries.items():
        rows = []
        for d, c in tf.items():
            s = sum(math.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * (k1 + 1) / (c[x] + k1 * (1 - b + b * length[d] / average)) for x in terms if c[x])
            if round(s, 6) > 0:
                rows.append((-round(s, 6), d))
        out |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(rows)[:k])}
    return out


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc long, terms array<string>").repartition(3)


def asked(spark, queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query string, term string")


def rows(df):
    return {(r.query, r.doc, round(r.score, 6), r["rank"]) for r in df.collect()}


QUERIES = {"common": ["t0", "t1", "t2"], "rare": ["t29", "t28", "t0"], "one": ["t17"], "mixed": ["t0", "t5", "t9", "t20", "t27", "nowhere"], "none": ["nowhere"]}


@pytest.mark.parametrize(("cell_docs", "cell_tokens", "block"), [(1 << 15, 1 << 22, 128), (40, 1 << 22, 4), (1 << 15, 300, 1)])
def test_bm25(spark, monkeypatch, cell_docs, cell_tokens, block):
    """Whatever the cells and blocks: ties, repeated documents, documents without terms, terms that no document has."""
    docs = documents(1)
    monkeypatch.setattr(lexical, "TOGETHER", 2)
    index = lexical.indexed(frame(spark, docs), block, cell_docs, cell_tokens).cache()
    assert lexical.totals(index).first().n == len(docs)
    for k in (1, 10, 1000):
        for k1, b in ((1.5, 0.75), (1.2, 0.0)):
            assert rows(lexical.bm25(index, asked(spark, QUERIES), k, k1, b)) == ranking(docs, QUERIES, k, k1, b)
    index.unpersist()


def test_blocks_are_skipped():
    """In one cell: exact results with few opened blocks where a rare term decides."""
    r = np.random.default_rng(2)
    n = 100_000
    lists = []
    for share in (0.9, 0.5, 0.001):
        at = np.flatnonzero(r.random(n) < share)
        tf, dl = r.integers(1, 9, len(at)).astype(float), r.integers(20, 400, len(at)).astype(float)
        heads = np.arange(0, len(at), lexical.BLOCK)
        lists.append(lexical.Postings(at, tf, dl, lexical.impact(np.maximum.reduceat(tf, heads), np.minimum.reduceat(dl, heads), 1.5, 0.75, 100.0)))
    scores = lambda x, at: lexical.impact(x.tf[at], x.dl[at], 1.5, 0.75, 100.0)
    for weights in ([0.1, 0.7, 7.0], [3.0, 0.5, 0.1], [1.0, 1.0, 1.0]):
        total = np.zeros(n)
        for x, w in zip(lists, weights, strict=True):
            total[x.at] += w * scores(x, np.arange(len(x.at)))
        some, score, opened = lexical.found(lists, weights, n, 10, scores)
        want = np.lexsort((np.arange(n), -np.round(total, 6)))[:10]
        assert some.tolist() == want.tolist() and np.allclose(score, total[want], atol=1e-6)
        blocks = sum(len(x.bounds) for x in lists)
        assert opened <= blocks and (weights[2] < 7 or opened < 0.2 * blocks)


def test_extended(spark, tmp_path):
    """An index is written once, and takes documents in without what it has being touched."""
    docs = documents(3)
    path = str(tmp_path / "index")
    lexical.stored(spark, path, frame(spark, docs[:250]))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").glob("*.parquet")}
    lexical.extended(path, frame(spark, docs[250:]))
    index = lexical.stored(spark, path, spark.createDataFrame([], "doc long, terms array<string>"))
    assert all(f.stat().st_mtime_ns == t for f, t in before.items()) and rows(lexical.bm25(index, asked(spark, QUERIES), 10)) == ranking(docs, QUERIES, 10, 1.5, 0.75)


def test_weights_and_matches(spark):
    docs = documents(4, 100)
    r = random.Random(1)
    weights = {d: [r.choice([0.5, 1.0, 6.0]) for _ in t or []] for d, t in docs}
    df = spark.createDataFrame([(d, t, weights[d]) for d, t in docs], "doc long, terms array<string>, weights array<double>")
    assert rows(lexical.bm25(lexical.indexed(df), asked(spark, QUERIES), 10, 1.2, 0.75)) == ranking(docs, QUERIES, 10, 1.2, 0.75, weights)
    # a term counts its confidence times smoothed rarity, once
    have = {d: set(t or []) for d, t in docs}
    n = {t: sum(t in h for h in have.values()) for t in QUERIES["mixed"]}
    idf = {t: math.log((len(docs) + 1) / (n[t] + 1)) + 1 for t in n}
    q = asked(spark, {"mixed": QUERIES["mixed"]}).withColumn("confidence", F.when(F.col("term") == "t5", -1.0).otherwise(0.5))
    want = sorted((-round(sum(0.5 * idf[t] for t in n if t != "t5" and t in h), 6), d) for d, h in have.items())
    assert rows(lexical.matched(lexical.indexed(df), q, 20)) == {("mixed", d, -s, i + 1) for i, (s, d) in enumerate(w for w in want if w[0] < 0) if i < 20}
    assert lexical.bm25(lexical.indexed(df.limit(0)), q, 5).collect() == []
