"""Listwise trees: gradients against a plain loop, the same trees however rows are dealt, and what they are good for."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import learning, listwise


def plain(grades, scores):
    """Gradients and weights of one query, pair by pair."""
    n = len(grades)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    place = {i: p for p, i in enumerate(order)}
    gain = [2**g - 1 for g in grades]
    ideal = sum(g / math.log2(p + 2) for p, g in enumerate(sorted(gain, reverse=True)))
    out, weight = [0.0] * n, [0.0] * n
    for i, j in itertools.permutations(range(n), 2):
        if grades[i] > grades[j]:
            swap = abs((gain[i] - gain[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
            wrong = 1 / (1 + math.exp(scores[i] - scores[j]))
            out[i] += swap * wrong
            out[j] -= swap * wrong
            weight[i] += swap * wrong * (1 - wrong)
            weight[j] += swap * wrong * (1 - wrong)
    return out, weight


def test_gradients():
    r = np.random.default_rng(1)
    sizes = [1, 2, 5, 5, 12, 30, 1]
    grades = [r.integers(0, 4, n).astype(float) for n in sizes] + [np.ones(4)]
    scores = [np.round(r.normal(0, 1, len(g)), 1) for g in grades]
    query = np.repeat(np.arange(len(grades)), list(map(len, grades)))
    got = listwise.gradients(query, np.concatenate(grades), np.concatenate(scores))
    want = [plain(g, s) for g, s in zip(grades, scores, strict=True)]
    for k in (0, 1):
        assert np.allclose(got[k], np.concatenate([w[k] for w in want]), atol=1e-12)
    assert not got[0][query == len(grades) - 1].any()  # grades all alike


@pytest.fixture(scope="module")
def rows(spark):
    """`a` tells a query's better candidates from its worse ones; `b` tells queries whose candidates are all better from others,
    which is most of what grades differ by, and nothing for an order; `c` says nothing, and is null or no number at times."""
    r = np.random.default_rng(5)
    out = []
    for q in range(300):
        shift = r.normal(0, 3)
        for d in range(12):
            a = r.normal()
            grade = int(a > 0.3) + int(a > 1.2) + 2 * int(shift > -1) + int(shift > 2)
            out.append((q, q * 100 + d, float(grade), float(a + r.normal(0, 0.3)), float(shift + r.normal(0, 0.5)), [None, float("nan"), float(r.normal())][int(r.integers(3))]))
    return spark.createDataFrame(out, "query long, doc long, label double, a double, b double, c double")


def test_trees(spark, rows, tmp_path):
    names = ("a", "b", "c")
    train, held = rows.where("query < 200"), rows.where("query >= 200")
    how = {"trees": 6, "depth": 3}
    nodes = sorted(map(tuple, listwise.stored(spark, str(tmp_path), train, names, **how).collect()), key=lambda n: n[:2])
    assert {n[0] for n in nodes} == set(range(6)) and all(0 <= n[1] < 15 for n in nodes) and {n[2] for n in nodes} <= {*names, None}
    # the same trees from other parts, and read again without a fit
    again = listwise.fitted(train.repartition(7).orderBy(F.desc("doc")), names, **how)
    assert sorted(map(tuple, again.collect()), key=lambda n: n[:2]) == nodes
    files = {f: f.stat().st_mtime_ns for f in tmp_path.glob("*/*.parquet")}
    model = listwise.stored(spark, str(tmp_path), train.repartition(3), names, **how)
    assert sorted(map(tuple, model.collect()), key=lambda n: n[:2]) == nodes and files == {f: f.stat().st_mtime_ns for f in tmp_path.glob("*/*.parquet")}
    assert len(list(tmp_path.iterdir())) == 1
    # the expression scores as the trees do
    scored = held.withColumn("score", listwise.score(model)).toPandas()
    by = {(t, n): (f, x, v) for t, n, f, x, v in nodes}
    for r in scored.itertuples():
        total = 0.0
        for t in range(6):
            n = 0
            while by[t, n][0] is not None:
                value = getattr(r, by[t, n][0])
                n = 2 * n + 1 + (value is not None and (value > by[t, n][1]))
            total += by[t, n][2]
        if r.c == r.c:  # pandas has no other null
            assert math.isclose(total, r.score, abs_tol=1e-12)


def test_better_than_pointwise(spark, rows, monkeypatch):
    """On held-out queries, with as many trees of the same depth on the same features, the order is better."""
    names = ("a", "b")
    monkeypatch.setattr(learning, "NAMES", names)
    train, held = rows.where("query < 200"), rows.where("query >= 200")
    nodes = listwise.fitted(train, names, trees=5, depth=2)
    of = lambda df: listwise.ndcg(df, 10).first().ndcg
    mine = of(held.withColumn("score", listwise.score(nodes)))
    point = of(learning.fitted(train, trees=5, depth=2).transform(held).withColumn("score", F.col("prediction")))
    assert mine > point + 0.005 and mine > of(held.withColumn("score", F.lit(0.0))) + 0.1


def test_ndcg(spark):
    df = spark.createDataFrame([("q", 1, 0.0, 3.0), ("q", 2, 2.0, 2.0), ("q", 3, 1.0, 2.0), ("none", 1, 0.0, 1.0)], "query string, doc int, label double, score double")
    got = listwise.ndcg(df).first()
    assert got.queries == 1 and math.isclose(got.ndcg, (3 / math.log2(3) + 1 / 2) / (3 + 1 / math.log2(3)))


def test_nothing_to_learn(spark, rows):
    alike = rows.where("query < 5").withColumn("label", F.lit(1.0))
    for df in (alike, rows.limit(0)):
        nodes = listwise.fitted(df, ("a",), trees=2, depth=2)
        assert nodes.count() == 0 and alike.select(listwise.score(nodes).alias("s")).distinct().collect() == [(0.0,)]
