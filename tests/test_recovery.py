"""Staged recovery against a loop over queries, and what later stages are given."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import recovery

PHRASES = {"rare": [1, 2], "some": [2, 3, 4, 5], "many": list(range(1, 30)), "none": []}


@pytest.mark.parametrize("k", [1, 5, 12])
def test_staged(spark, k):
    r = random.Random(k)
    constraints = [(q, p, c) for q in range(40) for p, c in zip(r.sample(list(PHRASES), r.randint(0, 4)), (0.9, None, 0.5, 0.5), strict=False)]
    last = {q: r.sample(range(40), r.randint(0, 20)) for q in range(40)}
    posted = spark.createDataFrame([(p, d) for p, ds in PHRASES.items() for d in ds], "phrase string, doc int")
    asked, appended = [], []

    def fused(some):
        """Documents that have all of a query's phrases, in order of id; what was asked is kept for the test."""
        asked.append({x.query for x in some.select("query").distinct().collect()})
        n = some.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
        hits = some.join(posted, "phrase").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("m")).join(n, "query").where("m = n")
        return hits.select("query", "doc", F.expr("row_number() over (partition by query order by doc)").alias("rank"))

    def final(some):
        appended.append({x.query for x in some.collect()})
        return spark.createDataFrame([(q, d, i + 1) for q, ds in last.items() for i, d in enumerate(ds)], "query int, doc int, rank int").join(some, "query", "left_semi")

    queries = spark.createDataFrame([(q,) for q in [*range(40), 3]], "query int")
    got = recovery.staged(queries, spark.createDataFrame(constraints, "query int, phrase string, confidence double"), fused, final, k).collect()
    want, reads, short = set(), [set() for _ in range(4)], set()
    for q in range(40):
        mine = sorted(((c is not None, c or 0.0, p) for i, p, c in constraints if i == q))
        for level in range(4):
            left = [p for _, _, p in mine[level:]]
            if left:
                reads[level].add(q)
            docs = sorted(set.intersection(*[set(PHRASES[p]) for p in left])) if left else []
            if len(docs) >= k or level >= min(3, len(mine)):
                break
        want |= {(q, d, "constraints", level, i + 1) for i, d in enumerate(docs)}
        if len(docs) < k:
            short.add(q)
            more = [d for d in last[q] if d not in docs][: k - len(docs)]
            want |= {(q, d, "lexical", level, len(docs) + i + 1) for i, d in enumerate(more)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert asked == reads[: len(asked)] and not any(reads[len(asked) :])  # a settled query is given to no later stage
    assert appended == ([short] if short else [])
