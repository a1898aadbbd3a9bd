"""Queries of the slot state, recovery, ablations, hashed vectors and the learnt reranker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import catalog as cat
from plumbline.operators import evaluation, learning, listwise, ranking, retrieval, sessions
from plumbline.plans.cleaning import CARDS, customer_targets, part_cards
from plumbline.plans.registry import query
from plumbline.plans.search import BM25, EXACT, part_features, two_routes
from plumbline.plans.simulation import session_simulation
from plumbline.sources.tables import materialised, shared_folder, table


@query("""WITH t AS (SELECT item_id AS id, sha256(unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS h FROM benchmark),
b AS (SELECT id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 64 AS place, 1.0::DOUBLE + (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2))::BIGINT % 7) * 0.1::DOUBLE AS bump FROM t),
s AS (SELECT id, place, sum(bump) AS w FROM b GROUP BY ALL) SELECT id, place, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM s""")
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hashed_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text")


def event_changes(events: DataFrame, *more: str) -> DataFrame:
    """Events as slot changes of their users: sign-ups change the category, the others slots of their type."""
    value = F.when(F.col("event_type") == "signup", (F.floor("value") % 2).cast("string")).otherwise((F.floor("value") % 4).cast("string"))
    return events.select(*more, F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "signup", "category").otherwise(F.col("event_type")).alias("attribute"), value.alias("value"), F.round(F.least(F.lit(1.0), F.col("value") / 100), 6).alias("confidence"))


@query("""WITH c AS (SELECT user_id AS session, event_id AS moment, CASE WHEN event_type = 'signup' THEN 'category' ELSE event_type END AS attribute, CAST(CAST(floor(value) AS BIGINT) % (CASE WHEN event_type = 'signup' THEN 2 ELSE 4 END) AS VARCHAR) AS value, round(least(1.0::DOUBLE, value / 100), 6) AS confidence FROM events),
l AS (SELECT *, lag(value) OVER (PARTITION BY session, attribute = 'category' ORDER BY moment) AS b FROM c), p AS (SELECT *, sum(CASE WHEN attribute = 'category' AND b IS NOT NULL AND b <> value THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY moment) AS part FROM l),
m AS (SELECT *, max(part) OVER (PARTITION BY session) AS last_part FROM p), s AS (SELECT *, lag(value) OVER (PARTITION BY session, attribute ORDER BY moment) AS old FROM m WHERE attribute <> 'category' AND part = last_part),
r AS (SELECT *, sum(CASE WHEN old IS NULL OR old <> value THEN 1 ELSE 0 END) OVER (PARTITION BY session, attribute ORDER BY moment) AS run FROM s), z AS (SELECT *, max(run) OVER (PARTITION BY session, attribute) AS last_run FROM r),
k AS (SELECT session, arg_max(value, moment) AS category FROM c WHERE attribute = 'category' GROUP BY session)
SELECT session, any_value(category) AS category, attribute, arg_max(value, moment) AS value, max(confidence) FILTER (run = last_run) AS confidence, max(moment) AS set_at, coalesce(array_to_string(list_sort(list_distinct(list(old) FILTER (old <> value))), ','), '') AS superseded FROM z LEFT JOIN k USING (session) GROUP BY session, attribute""")
def hybrid_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.category_slots(event_changes(table(spark, sf_dir, "events"))).withColumn("superseded", F.array_join("superseded", ","))


@query(f"""WITH {CARDS}, p AS (SELECT DISTINCT doc, unnest(constraints) AS phrase FROM cards), i AS (SELECT phrase, ln(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM p GROUP BY phrase),
q AS (SELECT c_custkey AS query, constraints[j] AS phrase, 1.0::DOUBLE / j AS confidence FROM customer JOIN cards ON doc = (c_custkey * 7) % (SELECT count(*) FROM part), generate_series(1, 4) AS g(j) WHERE j <= len(constraints) AND j <> 1),
w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence, phrase) AS weak FROM q), l AS (SELECT w.*, level FROM w, generate_series(0, 3) AS g(level) WHERE weak > level),
h AS (SELECT query, level, doc, round(sum(confidence * idf), 6) AS score FROM l JOIN p USING (phrase) JOIN i USING (phrase) GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY query, level ORDER BY score DESC, doc) AS rank FROM h WHERE score > 0 QUALIFY rank <= 50),
n AS (SELECT query, level, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT query, coalesce(min(level) FILTER (n >= 10), arg_max(level, n * 10 - level)) AS level FROM n GROUP BY query)
SELECT query, level, doc, score, rank FROM e JOIN f USING (query, level)""")
def recovery_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = part_cards(spark, sf_dir)
    posted = cat.postings(cards, "doc", "constraints").select("phrase", "doc")
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    idf = cat.smoothed_idf(posted, n)
    targets = customer_targets(spark, sf_dir)
    asked = targets.join(cards, "doc").select("query", F.posexplode(F.slice("constraints", 1, 4)).alias("j", "phrase")).where("j > 0").select("query", "phrase", (1.0 / (F.col("j") + 1)).alias("confidence"))
    return retrieval.recovered(asked, posted, idf)


ROUTES = {"full": ("lexical", "exact"), "lexical_only": ("lexical",), "exact_only": ("exact",)}


@query(f"""WITH {BM25}, {EXACT}, routes AS (SELECT 'lexical' AS route, query, doc, 0.6::DOUBLE / (60 + rank) AS part FROM lexical_hits WHERE rank <= 50 UNION ALL SELECT 'exact', query, doc, 1.0::DOUBLE / (60 + rank) FROM exact_hits WHERE rank <= 50),
v AS (SELECT * FROM (VALUES ('full', 'lexical'), ('full', 'exact'), ('lexical_only', 'lexical'), ('exact_only', 'exact')) t(variant, route)), f AS (SELECT variant, query, doc, round(sum(part) * (1 + 0.1::DOUBLE * (count(*) - 1)), 9) AS score FROM routes JOIN v USING (route) GROUP BY variant, query, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, query ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 10) SELECT variant, count(*) AS n, round(avg(CASE WHEN coalesce(quality, 0) = 1 THEN 1.0 ELSE 0.0 END), 6) AS good FROM r LEFT JOIN labels l ON l.doc_id = r.doc GROUP BY variant""")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = materialised(two_routes(spark, sf_dir))
    rows = reduce(DataFrame.unionByName, [ranking.fused(hits.where(F.col("route").isin(*routes)), n=10).withColumn("variant", F.lit(name)) for name, routes in ROUTES.items()])
    good = F.coalesce(F.col("quality"), F.lit(0)) == 1
    return rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality"), "doc", "left").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(good.cast("double")), 6).alias("good"))


def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with features, a grade (the wanted product 2, one that has all that was asked for 1), and the side of the split."""
    n = table(spark, sf_dir, "part").count()
    grade = F.when(F.col("query") * 7 % n == F.col("doc"), 2.0).when(F.col("coverage") >= 1.0, 1.0).otherwise(0.0)
    rows = materialised(part_features(spark, sf_dir).withColumn("label", grade))
    side = learning.split(rows.select(F.col("query").alias("id")))
    return materialised(rows.join(side.withColumnRenamed("id", "query"), "query"))


@query()
def learnt_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of customers beyond the training share, in the order of a listwise model fitted on the others'; the model is
    read if it has been fitted on the same rows before."""
    rows = judged_candidates(spark, sf_dir)
    model = listwise.stored(spark, f"{shared_folder(spark)}/models", rows.where("train"), learning.NAMES)
    return learning.rescored(rows.where(~F.col("train")).withColumn("prediction", listwise.score(model)), learning.PREDICTED)


@query()
def rerank_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG of the first ten on the held-out queries: by the fused score, the heuristic, and the listwise model."""
    rows = judged_candidates(spark, sf_dir)
    model = listwise.stored(spark, f"{shared_folder(spark)}/models", rows.where("train"), learning.NAMES)
    held = rows.where(~F.col("train"))
    orders = {"fused": F.col("fused"), "heuristic": ranking.heuristic(F.lit(True)), "listwise": listwise.score(model)}
    return reduce(DataFrame.unionByName, [listwise.ndcg(held.withColumn("score", by)).select(F.lit(name).alias("order"), "queries", F.round("ndcg", 6).alias("ndcg")) for name, by in orders.items()])


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'blue' WHEN turn % 3 = 1 THEN 'eu40' ELSE lower(role) || ' text' END AS said FROM conversations)
SELECT conv_id, turn, said, CASE WHEN turn % 3 = 0 THEN 'color' WHEN turn % 3 = 1 THEN 'size' ELSE 'material' END AS attribute, said AS value, CASE WHEN turn % 3 = 2 THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM t""")
def follow_up_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    said = F.when(k == 0, "blue").when(k == 1, "eu40").otherwise(F.concat(F.lower("role"), F.lit(" text")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return rows.withColumn("s", sessions.follow_up(text.normalise(F.col("said")), F.lit("material"))).select("conv_id", "turn", "said", "s.*")


@query()
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the simulated sessions reach the release threshold."""
    return evaluation.accepted(evaluation.metrics(session_simulation(spark, sf_dir)))
