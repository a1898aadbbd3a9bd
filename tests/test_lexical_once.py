"""What a list adds is made once for all queries, thresholds where something can be passed over, and only asked rows are exchanged."""

import numpy as np

from plumbline.operators import lexical


def test_impacts_are_given_and_thresholds_wait(monkeypatch):
    r = np.random.default_rng(3)
    n, lists = 3000, []
    for share in (0.6, 0.4, 0.3, 0.2, 0.1, 0.05):
        at = np.flatnonzero(r.random(n) < share)
        impacts = r.uniform(0.5, 1.0, len(at))
        lists.append(lexical.Postings(at, impacts, impacts, np.maximum.reduceat(impacts, np.arange(0, len(at), lexical.BLOCK)), lexical.BLOCK, impacts))
    made, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a: made.append(1) or partition(*a))
    total = np.zeros(n)
    for x in lists:
        total[x.at] += x.impacts
    some, score, opened = lexical.found(lists, [1.0] * 6, n, 10, None)
    want = np.lexsort((np.arange(n), -np.round(total, 6)))[:10]
    assert some.tolist() == want.tolist() and np.allclose(score, total[want], atol=1e-6)
    assert 0 < len(made) < len(lists) and opened <= sum(len(x.bounds) for x in lists)


def test_only_rows_that_are_asked_for_are_exchanged(spark):
    """Whatever Spark thinks of the sides' sizes."""
    index = lexical.indexed(spark.createDataFrame([(i, [f"t{i}", "all"]) for i in range(40)], "doc long, terms array<string>"))
    asked = spark.createDataFrame([("q", "t7", 2.0), ("q", "all", 1.0)], "query string, term string, weight double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lexical.search(index, asked, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [term" in plan and "LeftSemi" in plan
        assert [(r.doc, r.score) for r in found.where("doc is not null").orderBy("score", ascending=False).limit(1).collect()] == [(7, 3.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
