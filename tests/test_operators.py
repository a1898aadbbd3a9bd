"""Operators on small made-up tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text, utterance
from plumbline.operators import catalog, dense, evaluation, extraction, question, ranking, retrieval, sessions
from plumbline.sources import tables
from plumbline.streaming import sessions as streams

RECORDS = [
    {"parent_asin": "A", "title": "Navy Cotton Crew Neck T-Shirt", "features": '["100% cotton", "crew neck tee"]', "categories": '["Clothing", "Men", "T-Shirts"]', "details": '{"Color": "Navy", "Department": "mens"}', "price": "$19.99", "average_rating": "4.5", "rating_number": "120", "store": "Acme"},
    {"parent_asin": "B", "title": "Silk Blouse", "features": "[]", "categories": '["Clothing", "Women", "Blouses"]', "details": "not-json", "price": "None", "average_rating": "n/a", "rating_number": "", "store": None},
    {"asin": "C", "title": "Leather Belt", "features": '["leather"]', "description": '["Description", "A belt"]', "categories": '["Clothing"]', "price": "5 - 9"},
    {"title": "no id"},
]


def test_products(spark):
    got = {r.parent_asin: r for r in catalog.products(tables.from_records(spark, RECORDS)).collect()}
    assert sorted(got) == ["A", "B", "C"]
    a, b, c = got["A"], got["B"], got["C"]
    assert (a.price, a.rating_count, a.avg_rating, a.department, a.leaf_category, a.is_sparse) == (19.99, 120, 4.5, "men", "T-Shirts", False)
    assert (b.price, b.rating_count, b.avg_rating, b.department, b.is_sparse, c.price, c.description) == (None, 0, 0.0, "women", True, 5.0, "A belt")
    assert {"navy", "cotton", "men", "mens", "t-shirts", "crew neck tee", "color navy", "acme"} <= set(a.attr_phrases) and "silk blouse" in b.attr_phrases
    assert tables.product_cards(catalog.products(tables.from_records(spark, RECORDS))).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"parent_asin": "A", "details": {"b": 1}}\n\nnot json\n{"parent_asin": "B", "features": ["x"]}\n')
    rows = tables.lenient_catalog(spark, str(tmp_path / "c.jsonl")).orderBy("parent_asin").collect()
    assert [(r.parent_asin, r.details, r.features) for r in rows] == [("A", '{"b": 1}', None), ("B", None, '["x"]')]
    df = spark.range(3)
    path = tables.index_path(str(tmp_path), "v1", df)
    assert path == tables.index_path(str(tmp_path), "v1", df.orderBy(F.desc("id"))) != tables.index_path(str(tmp_path), "v1", spark.range(4))
    made = []
    for _ in range(2):
        assert tables.cached(spark, path, lambda: made.append(1) or df).count() == 3
    assert made == [1]
    tables.write_results(df, str(tmp_path / "out"), "r1")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_first_seen_and_popularity(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, at int, v string")
    assert {(r.k, r.v) for r in catalog.first_seen(rows, "k", "at").collect()} == {("a", "x"), ("b", "z")}
    items = spark.createDataFrame([(1, 5, 4.0), (2, 9, 1.0), (3, 5, 4.5), (4, 5, 4.0)], "id int, n int, stars double")
    assert [r.doc for r in catalog.popularity(items, "id", "n", "stars").orderBy("rank").collect()] == [2, 3, 1, 4]


def test_top_k_ties_and_pushdown(spark):
    hits = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 0.5)], "query string, doc string, score double")
    assert [r.doc for r in retrieval.best(hits, 2, ["query"]).orderBy("rank").collect()] == ["a", "b"]
    plan = retrieval.best(hits, 2, ["query"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_fusion_and_margin(spark):
    hits = spark.createDataFrame([("q", "exact", "a", 9.0, 1), ("q", "lexical", "a", 3.0, 2), ("q", "lexical", "b", 4.0, 1)], "query string, route string, doc string, score double, rank int")
    got = {r.doc: r.score for r in ranking.fused(hits).collect()}
    assert math.isclose(got["a"], (1 / 61 + 0.6 / 62) * 1.1, abs_tol=1e-9) and math.isclose(got["b"], 0.6 / 61, abs_tol=1e-9)
    one = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2), ("p", "a", 1.0, 1)], "query string, doc string, score double, rank int")
    assert {(r.query, r.margin) for r in ranking.margins(one).collect()} == {("q", 0.5), ("p", 1.0)}


def test_backfill(spark):
    own = spark.createDataFrame([("q", 7, 1)], "query string, doc int, rank int")
    popular = spark.createDataFrame([(i, i) for i in range(1, 9)], "doc int, rank int")
    got = retrieval.backfilled(own, popular, spark.createDataFrame([("q",), ("p",)], "query string"), 4).orderBy("query", "place").collect()
    assert [(r.query, r.doc) for r in got] == [("p", 1), ("p", 2), ("p", 3), ("p", 4), ("q", 7), ("q", 1), ("q", 2), ("q", 3)]


def test_unknown_bucket_means_all(spark):
    products = spark.createDataFrame([("a", "x", ["u"], 0.0, 0, 1.0), ("b", "y", ["w"], 0.0, 0, 1.0)], "doc string, bucket string, tokens array<string>, boost double, count int, price double")
    posted = spark.createDataFrame([("w", "b", 0)], "phrase string, doc string, position int")
    turns = spark.createDataFrame([("q", None, ["w"], ["w"]), ("p", "x", ["w"], ["w"])], "query string, bucket string, constraints array<string>, vocab array<string>")
    got = retrieval.pool_ranks(turns, products, posted).orderBy("query", "rank").collect()
    assert [(r.query, r.doc) for r in got] == [("p", "a"), ("q", "b"), ("q", "a")]


def test_question(spark):
    pool = spark.createDataFrame([("q", i, 1.0) for i in range(4)], "query string, doc int, score double")
    before = question.entropy(pool)
    assert math.isclose(before.first().entropy, math.log(4))
    values = spark.createDataFrame([("q", "color", c) for c in "abcd"] + [("q", "size", "s")] * 4, "query string, attribute string, value string")
    got = question.chosen(question.gains(values, before)).first()
    assert (got.attribute, round(got.gain, 4)) == ("color", round(math.log(4), 4))


def test_state_fold(spark):
    said = [(1, "I'm looking for Shoes. Prefer black."), (2, "For that, what matters is: cotton; wide."), (3, "Actually, ignore my earlier preference. What I need is: leather.")]
    turns = spark.createDataFrame([("s", t, m) for t, m in said], "session string, turn int, m string").select("session", "turn", text.word_set(F.col("m")).alias("words"), utterance.parse_event(F.col("m")).alias("event"))
    got = [r.state for r in sessions.folded(turns).orderBy("turn").collect()]
    assert got[1].bucket == "Shoes" and got[1].constraints == ["Prefer black.", "cotton", "wide"] and got[2].constraints == ["cotton", "wide", "leather"] and got[2].asked == 1 and "shoes" not in got[2].vocab


def test_repair(spark):
    rows = spark.createDataFrame([("q", ["Care: wipe clean", "imported", "cotton"]), ("p", ["a", "b"])], "query string, parts array<string>")
    posted = spark.createDataFrame([("Care: wipe clean; imported", 1), ("cotton", 2)], "phrase string, doc int")
    got = {r.query: r.constraints for r in sessions.repaired(rows, posted, F.lit(2)).collect()}
    assert got == {"q": ["Care: wipe clean; imported", "cotton"], "p": ["a", "b"]}


def test_slates_and_metrics(spark):
    items = spark.createDataFrame([("q", i, x) for i, x in enumerate(["A", "bad", "A", " B ", "C"])], "query string, pos int, id string")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    assert [r.id for r in evaluation.slates(items, known).orderBy("rank").collect()] == ["A", "B", "C"]
    rows = spark.createDataFrame([("x", True, 0.5, 2), ("x", False, 0.0, None)], "scenario string, hit boolean, reciprocal_rank double, first_hit_turn int")
    total = evaluation.metrics(rows).where("scenario is null").first()
    assert (total.hit_rate, total.mrr, total.mttc) == (0.5, 0.25, 6.5)
    assert evaluation.nearest_rank(spark.range(1, 101).select(F.lit("g").alias("g"), "id"), "g", "id", (0.5, 0.95)).first()[2:] == (50, 95)


def test_catalog_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n  [{"parent_asin": "A"}, {"parent_asin": "B", "price": 3}]')
    (tmp_path / "b.json").write_text('{"parent_asin": "A"}\n')
    (tmp_path / "bad.json").write_text('{"parent_asin": "A"}\nnot json\n')
    (tmp_path / "s.json").write_text('{"sample_id": "x", "scenario_type": "buying", "ground_truth": {"parent_asin": "A"}, "intent_card": {"hard_constraints": ["red"]}}\n')
    assert {r.parent_asin: r.price for r in tables.lenient_catalog(spark, str(tmp_path / "a.json")).collect()} == {"A": None, "B": "3"}
    assert tables.strict_catalog(spark, str(tmp_path / "b.json")).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.strict_catalog(spark, str(tmp_path / "bad.json")).collect()
    assert tables.samples(spark, str(tmp_path / "s.json")).first().intent_card.hard_constraints == ["red"]


def test_index_paths(spark, tmp_path):
    make = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x string")
    path = lambda df: tables.index_path("r", "v", df)
    assert path(make("a", "a", "b")) != path(make("c", "c", "b")) != path(make("b")) and path(make("a", "b")) == path(make("b", "a"))
    make("a").write.parquet(str(tmp_path / "t"))
    before = tables.file_path("r", "v", spark.read.parquet(str(tmp_path / "t")))
    assert before == tables.file_path("r", "v", spark.read.parquet(str(tmp_path / "t")))
    make("b").write.mode("append").parquet(str(tmp_path / "t"))
    assert before != tables.file_path("r", "v", spark.read.parquet(str(tmp_path / "t")))
    # an index whose files can't be read is made anew
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "_SUCCESS").write_text("")
    (tmp_path / "i" / "part-0.parquet").write_text("broken")
    assert tables.cached(spark, str(tmp_path / "i"), lambda: make("z")).first().x == "z"
    at = tables.write_vectors(spark.createDataFrame([(1, [0.5, 1.0])], "id long, vector array<double>"), str(tmp_path / "vectors"), "v", make("a"))
    assert spark.read.parquet(at).first().vector == [0.5, 1.0]


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(70, 5))
    x[7] = x[3]
    x[9] = 0
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc long, vector array<double>").repartition(3)
    got = retrieval.nearest(docs.where("doc < 20").withColumnRenamed("doc", "query"), docs, 4).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 6)
    want = {(q, d): k + 1 for q in range(20) for k, d in enumerate(sorted(range(70), key=lambda d: (-s[q, d], d))[:4])}
    assert {(a.query, a.doc): a.rank for a in got} == want


@pytest.mark.parametrize(("pivots", "parts", "k"), [(1, 1, 3), (40, 7, 10), (12, 3, 1), (5, 4, 700)])
def test_nearest_by_pivots(spark, pivots, parts, k):
    """Clustered and copied vectors, zeros, opposite ones, odd components: all of the best k; and far vectors are skipped."""
    r = np.random.default_rng(pivots)
    centres = r.normal(size=(12, 8))
    x = np.concatenate([centres[i % 12] + r.normal(0, 0.05, 8) for i in range(600)]).reshape(600, 8)
    x[50:60], x[60:64], x[64] = x[49], 0, -x[1]
    odd = [(900, None), (901, [1.0] * 7 + [None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8)]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "doc long, vector array<double>")
    asked = docs.where("doc % 9 = 0 or doc >= 900 or doc in (50, 61, 64)").withColumnRenamed("doc", "query")
    rows = dense.searched(asked, docs, k, pivots, parts).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 6)
    ids = [q for q in range(600) if q % 9 == 0 or q in (50, 61, 64)]
    for q in ids:
        mine = sorted((-round(a.score, 6), a.doc) for a in rows if a.query == q and a.doc is not None)[:k]
        assert [d for _, d in mine] == sorted(range(600), key=lambda d: (-s[q, d], d))[:k]
    assert {a.query for a in rows} == set(ids)
    done = sum(a.multiplied for a in rows if a.doc is None) / len(ids) / 600
    assert done <= 1.0 and (k != 10 or done < 0.5)
    assert dense.searched(asked, docs.limit(0), 3).collect() == []


def test_stream_fold(spark, tmp_path):
    """Two batches: the same states as in batch, and a turn that comes too late marked and without effect."""
    said = [(1, 1, "I'm looking for Shoes. Prefer black."), (1, 2, "For that, what matters is: cotton; wide."), (1, 3, "Actually, ignore my earlier preference. What I need is: leather."), (2, 1, "I'm looking for Hats. A key requirement is: red.")]
    rows = spark.createDataFrame(said, "session long, turn long, m string").select("session", "turn", text.word_set(F.col("m")).alias("words"), utterance.parse_event(F.col("m")).alias("event"))
    flat = rows.select("session", "turn", "words", F.col("event.kind").alias("kind"), F.col("event.category").alias("category"), F.col("event.constraints").alias("told"), F.col("event.scenario_hint").alias("hint"))
    at = str(tmp_path / "in")
    flat.where("turn < 3").coalesce(1).write.parquet(at)
    out = []
    for more in (None, flat.where("turn = 3").unionByName(flat.where("session = 1 and turn = 2"))):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(at)
        stream = streams.folded(spark.readStream.schema(flat.schema).parquet(at))
        done = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        done.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(r.session, r.turn): r.state for r in sessions.folded(rows).collect()}
    assert sorted((r.session, r.turn, r.late) for r in out) == [(1, 1, False), (1, 2, False), (1, 2, True), (1, 3, False), (2, 1, False)]
    for r in out:
        if not r.late:
            s = want[r.session, r.turn]
            assert (r.bucket, r.constraints, r.opening, r.n_vocab, r.asked) == (s.bucket, s.constraints, s.opening, len(s.vocab), s.asked)


def test_extraction(spark):
    said = spark.createDataFrame([(1, "Running shoes for her"), (2, "shoe"), (3, ""), (4, "trainers"), (5, "a b c d e f g h i j")], "query long, m string").select("query", extraction.utterance(F.col("m")).alias("text"))
    phrases = lambda *xs: spark.createDataFrame([(x,) for x in xs], "phrase string")
    vocabulary, categories = phrases("running shoes", "sneakers", "women", "shoes", "b c d e f g h i", "a b c d e f g h i"), phrases("shoes", "running shoes", "women", "fashion sneakers")
    got = {(r.query, r.source, r.phrase, r.confidence) for r in extraction.extracted(said, vocabulary, categories).collect()}
    assert {(p, s, c) for q, s, p, c in got if q == 1} == {("running shoes", "exact", 1.0), ("shoes", "exact", 1.0), ("sneakers", "exact", 1.0), ("women", "exact", 1.0), ("running shoes", "category", 1.0)}
    assert {(s, p) for q, s, p, _ in got if q == 2} == {("exact", "shoes"), ("category", "shoes")} and not any(q == 3 for q, *_ in got)
    assert {(s, p, c) for q, s, p, c in got if q == 4} == {("exact", "sneakers", 1.0), ("category", "fashion sneakers", 0.9)} and {p for q, _, p, _ in got if q == 5} == {"b c d e f g h i"}
    shares = {r["query"]: (r["n"], r["unknown"], r["ratio"]) for r in extraction.unknown_share(said, vocabulary).collect()}
    assert shares[2] == (1, 0, 0.0) and shares[3] == (0, 0, 0.0) and shares[4] == (1, 1, 1.0)
