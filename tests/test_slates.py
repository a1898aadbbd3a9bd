"""Slates whose ids are mostly one and the same: its rows are dealt over several pieces, and the result is that of a loop."""

from pyspark.sql import functions as F

from plumbline.operators import evaluation


def test_frequent_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "TOGETHER", 20)
    items = [(q, p, ("bad", f" {q} ", "", "7", "bad", str(q), " 7", None)[p]) for q in range(60) for p in range(8)] + [(None, 0, "7"), (None, 1, "bad")]
    known = ["7", *map(str, range(0, 60, 2)), "7"]
    rows = spark.createDataFrame(items, "query int, pos int, id string")
    dealt, each = evaluation.spread_ids(rows.where("id is not null"), spark.createDataFrame([(x,) for x in set(known)], "id string"))
    pieces = {r.id: r.n for r in dealt.groupBy("id").agg(F.count_distinct("piece").alias("n")).collect()}
    assert pieces["bad"] > 3 and pieces["7"] > 1 and pieces["4"] == 1
    assert dealt.join(each, ["id", "piece"], "left_semi").count() == dealt.where(F.col("id").isin(known)).count()
    want = set()
    for q in {q for q, _, _ in items}:
        first = {}
        for _, p, i in sorted((x for x in items if x[0] == q and x[2] and x[2].strip() in known), key=lambda x: x[1]):
            first.setdefault(i.strip(), p)
        want |= {(q, i, n + 1) for n, i in enumerate(list(first)[:1])}
    got = evaluation.slates(rows, spark.createDataFrame([(x,) for x in known], "id string"), 1)
    assert {tuple(x) for x in got.collect()} == want
