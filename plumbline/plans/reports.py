"""Queries of reports: breakdowns, worst rows, richness, orders of variants, totals, payloads, active constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT
from plumbline.operators import catalog as cat
from plumbline.operators import counters, evaluation, retrieval, sessions
from plumbline.plans.cleaning import CARDS, customer_targets, part_cards
from plumbline.plans.more import ablation_matrix, event_changes, recovery_levels
from plumbline.plans.registry import ORACLE, listed, query
from plumbline.plans.search import popularity_backfill
from plumbline.plans.understanding import question_choice, semantic_trigger
from plumbline.sources.tables import table

_JUDGED = """j AS (SELECT d.doc_id, lang AS scenario, source AS difficulty, coalesce(quality, 0) = 1 AS hit, CASE WHEN coalesce(quality, 0) = 1 THEN 1 + d.doc_id % 10 END AS best_rank,
  CASE WHEN coalesce(quality, 0) = 1 THEN 1 + d.doc_id % 10 WHEN d.doc_id % 3 > 0 THEN 11 + d.doc_id % 60 END AS pool_rank FROM documents d LEFT JOIN labels l USING (doc_id))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions: good ones are hits, of the others two thirds were in the pool."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("scenario"), F.col("source").alias("difficulty")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    hit, at = F.coalesce(F.col("quality"), F.lit(0)) == 1, F.col("doc_id")
    return rows.select("doc_id", "scenario", "difficulty", hit.alias("hit"), F.when(hit, 1 + at % 10).alias("best_rank"), F.when(hit, 1 + at % 10).when(at % 3 > 0, 11 + at % 60).alias("pool_rank"))


@query(f"""WITH {_JUDGED}, g AS (SELECT 'scenario' AS scope, scenario AS value, * EXCLUDE (scenario, difficulty) FROM j UNION ALL SELECT 'difficulty', difficulty, * EXCLUDE (scenario, difficulty) FROM j UNION ALL SELECT 'all', NULL, * EXCLUDE (scenario, difficulty) FROM j)
SELECT scope, value, count(*) AS sessions, count(*) FILTER (hit AND best_rank = 1) AS rank_1, count(*) FILTER (hit AND best_rank IN (2, 3)) AS rank_2_3, count(*) FILTER (hit AND best_rank BETWEEN 4 AND 10) AS rank_4_10,
  count(*) FILTER (NOT hit) AS misses, count(*) FILTER (NOT hit AND pool_rank IS NOT NULL) AS misses_in_pool, count(*) FILTER (NOT hit AND pool_rank IS NULL) AS misses_not_in_pool, count(*) FILTER (hit AND best_rank <> 1) AS hits_not_rank_1,
  round(coalesce(sum(best_rank) FILTER (hit), 0) / greatest(count(*) FILTER (hit), 1), 4) AS mean_rank_of_hits FROM g GROUP BY scope, value""")
def miss_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.breakdown(judged(spark, sf_dir), ["scenario", "difficulty"])


@query(f"""WITH {_JUDGED}, w AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY hit, pool_rank DESC NULLS FIRST, best_rank DESC NULLS FIRST, doc_id) AS nth FROM j)
SELECT scenario, nth, doc_id, hit, coalesce(pool_rank, 0) AS pool_rank, coalesce(best_rank, 0) AS best_rank FROM w WHERE nth <= 8""")
def worst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place 0: not in the pool, or not in the slate."""
    return evaluation.worst(judged(spark, sf_dir), "scenario", 8, "doc_id").na.fill(0, ["pool_rank", "best_rank"])


@query("""WITH r AS (SELECT p_size % 6 + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS richness FROM part), n AS (SELECT count(*) AS n FROM r), o AS (SELECT richness, row_number() OVER (ORDER BY richness) AS nth FROM r)
SELECT n.n, (SELECT count(*) FROM r WHERE richness < 2) AS sparse, (SELECT CAST(richness AS BIGINT) FROM o, n m WHERE nth = greatest(1, CAST(floor(m.n * 0.1) AS BIGINT))) AS p10 FROM n""")
def catalog_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of features and description, as far as a part has such a thing."""
    return evaluation.richness(table(spark, sf_dir, "part"), F.col("p_size") % 6 + F.when(F.col("p_retailprice") > 1000, 1).otherwise(0), DEFAULT.sparse_below)


@query(f"""WITH v AS ({ORACLE["ablation_matrix"]}) SELECT row_number() OVER (ORDER BY good DESC, variant) AS place, variant, good, round(max(good) OVER () - good, 6) AS behind FROM v""")
def ablation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ordered_variants(ablation_matrix(spark, sf_dir), "variant", "good")


@query("""WITH t AS (SELECT CASE WHEN length(text) % 5 > 0 THEN length(text) - 40 END AS p, CAST(turn AS BIGINT) - 1 AS c FROM conversations)
SELECT CAST(coalesce(sum(p) FILTER (p >= 0), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(c) FILTER (c >= 0), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(p) FILTER (p >= 0), 0) + coalesce(sum(c) FILTER (c >= 0), 0) AS BIGINT) AS total_tokens FROM t""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are missing or negative add nothing."""
    size = F.length("text").cast("long")
    return evaluation.usage(table(spark, sf_dir, "conversations").select(F.when(size % 5 > 0, size - 40).alias("prompt_tokens"), (F.col("turn") - 1).alias("completion_tokens")))


@query("""WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS nth FROM part QUALIFY nth <= 3)
SELECT p_type, 'Here is what fits ' || p_type || '.' AS message, 'color' AS ask_attribute, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY nth) AS ids, CAST(0 AS BIGINT) AS tokens FROM r GROUP BY p_type""")
def response_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each type, and what reads it back: padded and empty ids are trimmed and left out."""
    top = retrieval.best(table(spark, sf_dir, "part").select(F.col("p_type").alias("query"), F.col("p_partkey").alias("doc"), F.col("p_retailprice").alias("score")), 3, ["query"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: F.concat(F.lit(" "), x["doc"].cast("string")))
    rows = top.groupBy("query").agg(ids.alias("ids")).select(F.col("query").alias("p_type"), evaluation.payload(F.concat(F.lit("Here is what fits "), "query", F.lit(".")), F.lit("color"), F.concat("ids", F.array(F.lit("  ")))).alias("p"))
    return rows.select("p_type", "p.message", "p.ask_attribute", F.array_join(evaluation.ids_of(F.col("p.recommendations")), ",").alias("ids"), (F.col("p.usage.prompt_tokens") + F.col("p.usage.completion_tokens")).cast("long").alias("tokens"))


@query(f"""WITH {CARDS}, p AS (SELECT DISTINCT doc, unnest(constraints) AS phrase FROM cards), i AS (SELECT phrase, ln(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM p GROUP BY phrase),
c AS (SELECT c_custkey AS query, bucket, constraints FROM customer JOIN cards ON doc = (c_custkey * 7) % (SELECT count(*) FROM part)), q AS (SELECT query, bucket, phrase FROM (SELECT query, bucket, unnest(constraints) AS phrase FROM c) WHERE phrase LIKE 'brand:%'),
s AS (SELECT query, doc, 0.8::DOUBLE * idf AS s FROM q JOIN p USING (phrase) JOIN i USING (phrase) UNION ALL SELECT query, cards.doc, 0.75::DOUBLE FROM q JOIN cards ON cards.bucket = q.bucket),
h AS (SELECT query, doc, round(sum(s), 6) AS score FROM s GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h QUALIFY rank <= 50""")
def exact_leaf_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand, and the category that is wanted, whose products have a boost."""
    cards = part_cards(spark, sf_dir)
    posted = cat.postings(cards, "doc", "constraints").select("phrase", "doc")
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    targets = customer_targets(spark, sf_dir)
    asked = targets.join(cards, "doc").select("query", F.col("bucket").alias("category"), F.explode("constraints").alias("phrase")).where(F.col("phrase").startswith("brand:")).withColumn("confidence", F.lit(0.8))
    return retrieval.exact_phrases(asked, posted, cat.smoothed_idf(posted, n), cards.select("doc", F.col("bucket").alias("leaf"))).select("query", "doc", "score", "rank")


_SLOTS = ORACLE["hybrid_slots"].replace("event_id AS moment", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS moment")


@query(f"""WITH slots AS ({_SLOTS}), t AS (SELECT user_id AS session, count(*) AS turn FROM events GROUP BY 1), w AS (SELECT slots.*, confidence * power(0.95::DOUBLE, greatest(turn - set_at, 0)) AS weight FROM slots JOIN t USING (session))
SELECT session, attribute, value AS phrase, round(weight, 6) AS confidence FROM w UNION ALL SELECT session, attribute, unnest(string_split(superseded, ',')), round(weight * 0.4::DOUBLE, 6) FROM w WHERE superseded <> ''
UNION ALL SELECT DISTINCT session, 'category', category, 1.0::DOUBLE FROM w WHERE category IS NOT NULL AND category <> ''""")
def active_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's slots ask for at its last turn: faded with age, superseded values less, the category whole."""
    changes = event_changes(table(spark, sf_dir, "events")).withColumn("at", F.row_number().over(Window.partitionBy("session").orderBy("at")).cast("long"))
    turns = changes.groupBy("session").agg(F.max("at").alias("turn"))
    return sessions.active(sessions.category_slots(changes), turns)


@query(f"""SELECT 'semantic_fallback_fired' AS counter, count(*) FILTER (needs) AS n FROM ({ORACLE["semantic_trigger"]}) UNION ALL SELECT 'recovered_' || l, (SELECT count(DISTINCT query) FROM ({ORACLE["recovery_levels"]}) WHERE level = l) FROM generate_series(1, 3) AS g(l)
UNION ALL SELECT 'backfilled', count(DISTINCT query) FROM ({ORACLE["popularity_backfill"]}) WHERE tier = 1
UNION ALL SELECT 'ask_' || a, (SELECT count(*) FROM ({ORACLE["question_choice"]}) WHERE ask = a) FROM (SELECT unnest({listed(DEFAULT.ask_attributes)}) AS a) UNION ALL SELECT 'ask_none', count(*) FROM ({ORACLE["question_choice"]}) WHERE ask IS NULL""")
def turn_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often turns fell back to meaning, were recovered with fewer constraints, were filled up by popularity, and asked for what."""
    _, fell = counters.written(semantic_trigger(spark, sf_dir), {"semantic_fallback_fired": F.col("needs")})
    _, fewer = counters.written(recovery_levels(spark, sf_dir), {f"recovered_{i}": (F.col("level") == i) & (F.col("rank") == 1) for i in (1, 2, 3)})
    filled = popularity_backfill(spark, sf_dir).withColumn("first", (F.col("tier") == 1) & (F.row_number().over(Window.partitionBy("query", "tier").orderBy("place")) == 1))
    _, more = counters.written(filled, {"backfilled": F.col("first")})
    _, asked = counters.written(question_choice(spark, sf_dir), counters.asks(F.col("ask"), DEFAULT.ask_attributes))
    return counters.reported(spark, fell, fewer, more, asked)
