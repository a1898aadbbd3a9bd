"""Queries over turns, sessions, questions and evaluations."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT
from plumbline.functions import lexicon, text, utterance
from plumbline.operators import catalog as cat
from plumbline.operators import evaluation, question, ranking, retrieval, sessions
from plumbline.plans.cleaning import CARDS, customer_targets, part_cards
from plumbline.plans.registry import CATALOG, listed, query
from plumbline.plans.search import FUSED, WHOLE_POOL, lexical_hits, phrase_hits, pool_turns, two_routes
from plumbline.sources.tables import materialised, table

MESSAGES = """CASE p_partkey % 10 WHEN 0 THEN 'I''m looking for ' || p_name || '. A key requirement is: ' || p_brand || '.' WHEN 1 THEN 'I''m looking for ' || p_name || ', but I''m still exploring.' WHEN 2 THEN 'I''m looking for ' || p_name || '. Prefer ' || p_type
  WHEN 3 THEN 'Actually, ignore my earlier preference. What I need is: ' || p_type || '.' WHEN 4 THEN 'For that, what matters is: ' || p_brand || '; ' || p_type || '.' WHEN 5 THEN 'I don''t have an additional preference for ' || p_type || '.'
  WHEN 6 THEN 'I don''t have a preference for ' || p_type || '; please use your judgment.' WHEN 7 THEN 'Those options are not quite right yet. Ask me about one specific attribute.' WHEN 8 THEN 'um, I''m still exploring, but I''m looking for ' || p_name ELSE 'hello ' || p_name END"""


def part_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each part, by templates in turn."""
    return templates(table(spark, sf_dir, "part"))


def templates(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey") % 10
    c = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    lead = c("I'm looking for ", name)
    message = (
        F.when(k == 0, c(lead, ". A key requirement is: ", brand, ".")).when(k == 1, c(lead, ", but I'm still exploring.")).when(k == 2, c(lead, ". Prefer ", kind)).when(k == 3, c("Actually, ignore my earlier preference. What I need is: ", kind, "."))
        .when(k == 4, c("For that, what matters is: ", brand, "; ", kind, ".")).when(k == 5, c("I don't have an additional preference for ", kind, ".")).when(k == 6, c("I don't have a preference for ", kind, "; please use your judgment."))
        .when(k == 7, F.lit(utterance.REBUKE)).when(k == 8, c("um, I'm still exploring, but ", lead)).otherwise(c("hello ", name))
    )
    return p.select("p_partkey", message.alias("message"))


@query(f"""WITH m AS (SELECT p_partkey, {MESSAGES} AS message, p_name, p_brand, p_type, p_partkey % 10 AS k FROM part)
SELECT p_partkey, message, CASE WHEN k IN (0, 1, 2, 8) THEN 'opening' WHEN k = 3 THEN 'override' WHEN k = 4 THEN 'disclosure' WHEN k = 5 THEN 'exhausted' WHEN k = 6 THEN 'no_preference' WHEN k = 7 THEN 'rebuke' ELSE 'unknown' END AS kind,
  CASE WHEN k IN (0, 1, 2, 8) THEN p_name END AS category, CASE k WHEN 0 THEN p_brand WHEN 2 THEN 'Prefer ' || p_type WHEN 3 THEN p_type WHEN 4 THEN p_brand || ' | ' || p_type ELSE '' END AS constraints,
  CASE WHEN k IN (5, 6) THEN p_type END AS attribute, CASE k WHEN 0 THEN 'buying' WHEN 1 THEN 'browsing' WHEN 2 THEN 'intent_override' WHEN 8 THEN 'browsing' END AS scenario_hint FROM m""")
def event_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_messages(spark, sf_dir).withColumn("e", utterance.parse_event(F.col("message")))
    return rows.select("p_partkey", "message", F.col("e.kind").alias("kind"), F.col("e.category").alias("category"), F.array_join("e.constraints", " | ").alias("constraints"), F.col("e.attribute").alias("attribute"), F.col("e.scenario_hint").alias("scenario_hint"))


@query(f"""WITH {CARDS}, p AS (SELECT DISTINCT doc, phrase FROM (SELECT doc, unnest(list_append(constraints, 'size: ' || CAST(doc % 7 AS VARCHAR) || '; imported')) AS phrase FROM cards)), d AS (SELECT phrase, count(*) AS df FROM p GROUP BY phrase),
f AS (SELECT doc AS query, CASE WHEN doc % 3 = 0 THEN ['size: ' || CAST(doc % 7 AS VARCHAR), 'imported', lower(bucket)] WHEN doc % 3 = 1 THEN ['x', 'y', 'z'] ELSE [lower(bucket), 'budget'] END AS parts FROM cards),
c AS (SELECT query, parts, cut, CASE WHEN cut = 0 THEN [array_to_string(parts, '; ')] ELSE [array_to_string(list_slice(parts, 1, cut), '; '), array_to_string(list_slice(parts, cut + 1, len(parts)), '; ')] END AS groups FROM f, generate_series(0, 2) AS g(cut) WHERE len(parts) > 2),
e AS (SELECT query, cut, unnest(groups) AS phrase FROM c), s AS (SELECT query, cut, round(sum(CASE WHEN df > 0 THEN 1000 + ln(((SELECT count(*) FROM part) + 1.0) / (df + 1.0)) ELSE -1.0 END), 9) AS score FROM e LEFT JOIN d USING (phrase) GROUP BY query, cut),
b AS (SELECT query, groups, score FROM c JOIN s USING (query, cut) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, len(groups), cut) = 1)
SELECT query, array_to_string(CASE WHEN score > 0 THEN groups ELSE parts END, ' | ') AS constraints FROM f LEFT JOIN b USING (query)""")
def repair_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = part_cards(spark, sf_dir)
    posted = cards.select("doc", F.explode(F.concat("constraints", F.array(F.concat(F.lit("size: "), (F.col("doc") % 7).cast("string"), F.lit("; imported"))))).alias("phrase")).distinct()
    k = F.col("doc") % 3
    low = F.lower("bucket")
    parts = F.when(k == 0, F.array(F.concat(F.lit("size: "), (F.col("doc") % 7).cast("string")), F.lit("imported"), low)).when(k == 1, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).otherwise(F.array(low, F.lit("budget")))
    n = table(spark, sf_dir, "part").count()
    out = sessions.repaired(cards.select(F.col("doc").alias("query"), parts.alias("parts")), posted, F.lit(n))
    return out.select("query", F.array_join("constraints", " | ").alias("constraints"))


@query("""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)
SELECT doc_id, count(*) AS n_known FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) WHERE term IN (SELECT term FROM v) GROUP BY doc_id""")
def constraint_lookup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = table(spark, sf_dir, "benchmark").select(F.explode(text.word_set(F.col("text"))).alias("term")).distinct()
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.word_set(F.col("text"))).alias("term"))
    return terms.join(vocab, "term", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known"))


@query("""WITH v AS (SELECT DISTINCT lower(p_type) AS phrase FROM part UNION SELECT DISTINCT lower(p_type || ' ' || p_name) FROM part UNION SELECT DISTINCT lower(p_name) FROM part),
m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower('show me ' || p_type || ' ' || p_name || ' please') WHEN 1 THEN lower('a ' || p_name || ' in ' || p_type) ELSE 'nothing of note' END AS message FROM part)
SELECT p_partkey, message, (SELECT max(phrase) FROM (SELECT phrase FROM v WHERE contains(' ' || message || ' ', ' ' || phrase || ' ') ORDER BY length(phrase) DESC, phrase LIMIT 1)) AS category FROM m""")
def category_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    vocab = p.select(F.explode(F.array(F.lower("p_type"), F.lower(F.concat_ws(" ", "p_type", "p_name")), F.lower("p_name"))).alias("phrase")).distinct()
    k = F.col("p_partkey") % 3
    message = F.when(k == 0, F.lower(F.concat(F.lit("show me "), "p_type", F.lit(" "), "p_name", F.lit(" please")))).when(k == 1, F.lower(F.concat(F.lit("a "), "p_name", F.lit(" in "), "p_type"))).otherwise("nothing of note")
    rows = p.select("p_partkey", message.alias("message"))
    grams = rows.select("p_partkey", F.explode(text.ngrams(F.col("message"), 1, 8)).alias("phrase")).join(vocab, "phrase", "left_semi")
    best = grams.groupBy("p_partkey").agg(F.min(F.struct((-F.length("phrase")).alias("n"), "phrase")).alias("b"))
    return rows.join(best, "p_partkey", "left").select("p_partkey", "message", F.col("b.phrase").alias("category"))


@query("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, token, min(turn) AS turn FROM t GROUP BY ALL), n AS (SELECT conv_id, turn, count(*) AS fresh FROM f GROUP BY ALL), u AS (SELECT DISTINCT conv_id, turn FROM t)
SELECT conv_id, turn, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n FROM u LEFT JOIN n USING (conv_id, turn)""")
def running_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    return sessions.running_distinct(t).withColumnRenamed("session", "conv_id")


_EVENTS = f"""t0 AS (SELECT p_partkey // 10 AS session, ((p_partkey % 10) * 7 + p_partkey // 10) % 10 + 1 AS turn, {MESSAGES} AS message, p_name, p_brand, p_type, p_partkey % 10 AS k FROM part),
t AS (SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY turn) AS i, list_filter(w, lambda x, j: list_position(w, x) = j) AS words, CASE WHEN k IN (0, 1, 2, 8) THEN 'opening' WHEN k = 3 THEN 'override' ELSE 'x' END AS kind, CASE WHEN k IN (0, 1, 2, 8) THEN p_name END AS category,
  CASE k WHEN 0 THEN [p_brand] WHEN 2 THEN ['Prefer ' || p_type] WHEN 3 THEN [p_type] WHEN 4 THEN [p_brand, p_type] ELSE [] END AS told, CASE WHEN k = 2 THEN 'intent_override' END AS hint FROM (SELECT *, regexp_extract_all(lower(message), '[a-z0-9]+') AS w FROM t0))"""
FOLD_SQL = f"""WITH RECURSIVE {_EVENTS}, s AS (
SELECT session, 0::BIGINT AS i, 0::BIGINT AS turn, NULL::VARCHAR AS bucket, []::VARCHAR[] AS cs, []::VARCHAR[] AS opening, []::VARCHAR[] AS vocab, 0::BIGINT AS asked FROM (SELECT DISTINCT session FROM t)
UNION ALL SELECT session, i, turn, CASE WHEN opens THEN category ELSE bucket END, list_concat(kept, list_filter(told, lambda x: NOT list_contains(kept, x))), CASE WHEN over THEN []::VARCHAR[] WHEN opens AND hint = 'intent_override' THEN told ELSE opening END,
  CASE WHEN over THEN words ELSE list_concat(vocab, list_filter(words, lambda x: NOT list_contains(vocab, x))) END, CASE WHEN over THEN 1 ELSE asked + 1 END
  FROM (SELECT t.session, t.i, t.turn, t.words, t.category, t.told, t.hint, s.bucket, s.opening, s.vocab, s.asked, t.kind = 'override' AS over, t.kind = 'opening' AND t.category IS NOT NULL AND s.bucket IS NULL AS opens,
    CASE WHEN t.kind = 'override' THEN list_filter(s.cs, lambda x: NOT list_contains(s.opening, x)) ELSE s.cs END AS kept FROM s JOIN t ON t.session = s.session AND t.i = s.i + 1))
SELECT session, turn, bucket, array_to_string(cs, ' | ') AS constraints, array_to_string(opening, ' | ') AS opening, len(vocab) AS n_vocab, asked{{more}} FROM s WHERE i > 0"""


def template_turns(parts: DataFrame) -> DataFrame:
    """Sessions of ten turns (session, turn, words, event): parts' template messages, in another order in each session."""
    key, message = F.col("p_partkey"), F.col("message")
    turn = (key % 10 * 7 + F.floor(key / 10)) % 10 + 1
    return templates(parts).select(F.floor(key / 10).alias("session"), turn.cast("bigint").alias("turn"), text.word_set(message).alias("words"), utterance.parse_event(message).alias("event"))


@query(FOLD_SQL.format(more=""))
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after each turn."""
    rows = sessions.folded(template_turns(table(spark, sf_dir, "part")))
    return rows.select("session", "turn", F.col("state.bucket").alias("bucket"), F.array_join("state.constraints", " | ").alias("constraints"), F.array_join("state.opening", " | ").alias("opening"), F.size("state.vocab").cast("bigint").alias("n_vocab"), F.col("state.asked").cast("bigint").alias("asked"))


@query("""WITH e AS (SELECT user_id, event_type, value, event_id FROM events) SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS set_at, len(list_distinct(list(value))) - 1 AS n_superseded FROM e GROUP BY ALL""")
def slot_override_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("slot"), "value", F.col("event_id").alias("at"))
    return sessions.slots(rows).select(F.col("session").alias("user_id"), F.col("slot").alias("event_type"), "value", "set_at", F.size("superseded").cast("bigint").alias("n_superseded"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) > 1 AS superseded FROM events)
SELECT event_id, age, superseded, round(least(1.0::DOUBLE, value / 100) * power(0.95::DOUBLE, least(age, 100)) * (CASE WHEN superseded THEN 0.4::DOUBLE ELSE 1 END) + 1e-9::DOUBLE, 6) AS weight FROM e""")
def decayed_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("event_id")))
    rows = e.select("event_id", "value", (newest("user_id") - 1).cast("bigint").alias("age"), (newest("user_id", "event_type") > 1).alias("superseded"))
    return rows.select("event_id", "age", "superseded", F.round(sessions.decayed(F.least(F.lit(1.0), F.col("value") / 100), F.least("age", F.lit(100)), F.col("superseded")) + 1e-9, 6).alias("weight"))


@query("""WITH t AS (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n FROM conversations)
SELECT conv_id, turn, n, n >= 2 OR turn >= 10 OR (n >= 1 AND turn >= 4) AS emits FROM t""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n")).withColumn("emits", sessions.emits(F.col("n"), F.col("turn")))


@query("""SELECT conv_id, turn, ['other', 'other', 'material', 'color', 'budget', 'style', 'feature', 'use_case', 'size'][least(row_number() OVER (PARTITION BY conv_id ORDER BY turn), 9)] AS ask FROM conversations WHERE role = 'user'""")
def ask_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", asked.alias("n")).select("conv_id", "turn", question.planned(F.col("n")).alias("ask"))


@query(f"""WITH {CATALOG}, s AS (SELECT bucket AS query, doc, greatest(cnt, 0) AS s, sum(greatest(cnt, 0)) OVER (PARTITION BY bucket) AS total FROM catalog)
SELECT query, count(*) AS n, round(CASE WHEN max(total) > 0 THEN sum(CASE WHEN s > 0 THEN -(s / total) * ln(s / total) ELSE 0 END) ELSE ln(count(*)) END, 6) AS entropy FROM s GROUP BY query""")
def pool_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.plans.cleaning import catalog

    pool = catalog(spark, sf_dir).select(F.col("bucket").alias("query"), "doc", F.col("cnt").cast("double").alias("score"))
    return question.entropy(pool).select("query", "n", F.round("entropy", 6).alias("entropy"))


VALUES = """v AS (SELECT p_type AS query, p_partkey, 'brand' AS attribute, lower(p_brand) AS value FROM part UNION ALL SELECT p_type, p_partkey, 'size', CAST(p_size // 10 AS VARCHAR) FROM part UNION ALL SELECT p_type, p_partkey, 'budget', CASE WHEN p_retailprice < 20 THEN 'low' WHEN p_retailprice < 50 THEN 'mid' ELSE 'high' END FROM part
  UNION ALL SELECT p_type, p_partkey, 'color', regexp_extract(p_name, '(red|blue)', 1) FROM part WHERE regexp_matches(p_name, 'red|blue'))"""


@query(f"""WITH {VALUES}, h AS (SELECT p_type AS query, ln(count(*)) AS entropy FROM part GROUP BY 1), c AS (SELECT query, attribute, value, count(*) AS c FROM v GROUP BY ALL), g AS (SELECT query, attribute, round(CASE WHEN sum(c) < 2 THEN 0 ELSE greatest(0, max(entropy) - sum(c * ln(c)) / sum(c)) END, 6) AS gain, max(entropy) AS entropy FROM c JOIN h USING (query) GROUP BY query, attribute),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, list_position({listed(('category', 'material', 'color', 'size', 'style', 'brand', 'budget', 'feature', 'use_case', 'other'))}, attribute)) AS nth FROM g)
SELECT query, CASE WHEN entropy >= ln(3) AND gain >= 0.15 THEN attribute END AS attribute, CASE WHEN entropy >= ln(3) AND gain >= 0.15 THEN gain END AS gain FROM b WHERE nth = 1""")
def info_gain_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    color = F.nullif(F.regexp_extract("p_name", "(red|blue)", 1), F.lit(""))
    values = {"brand": F.lower("p_brand"), "size": F.floor(F.col("p_size") / 10).cast("string"), "budget": lexicon.price_bucket(F.col("p_retailprice")), "color": color}
    rows = p.select(F.col("p_type").alias("query"), F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in values.items()])).alias("x")).select("query", "x.*").where("value is not null")
    before = p.groupBy(F.col("p_type").alias("query")).agg(F.log(F.count(F.lit(1)).cast("double")).alias("entropy"))
    return question.chosen(question.gains(rows, before))


@query(f"""WITH i AS (SELECT o_orderkey AS query, g.pos, CASE g.pos % 5 WHEN 0 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN 1 THEN 'bad' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN CAST((o_custkey + g.pos) % 1500 AS VARCHAR) ELSE '' END AS id FROM orders, generate_series(0, 15) AS g(pos)),
f AS (SELECT query, trim(id) AS id, min(pos) AS pos FROM i WHERE trim(id) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY ALL) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank FROM f QUALIFY rank <= 10""")
def slate_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    k, c = F.col("pos") % 5, F.col("o_custkey").cast("string")
    id_ = F.when(k == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 1, "bad").when(k == 2, c).when(k == 3, ((F.col("o_custkey") + F.col("pos")) % 1500).cast("string")).otherwise("")
    return evaluation.slates(items.select("query", "pos", id_.alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")))


#: Documents as sessions: a hit if the label says quality 1, at a turn and rank from the id.
SESSIONS = """sessions AS (SELECT d.doc_id, d.lang AS scenario, coalesce(l.quality, 0) = 1 AS hit, CASE WHEN coalesce(l.quality, 0) = 1 THEN 1 + d.doc_id % 10 END AS rank, CASE WHEN coalesce(l.quality, 0) = 1 THEN 1 + d.doc_id % 4 END AS first_hit_turn FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(F.col("quality"), F.lit(0)) == 1
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.col("lang").alias("scenario"), hit.alias("hit"), F.when(hit, 1 + F.col("doc_id") % 10).alias("rank"), F.when(hit, 1 + F.col("doc_id") % 4).alias("first_hit_turn")).withColumn("reciprocal_rank", F.when(F.col("hit"), 1.0 / F.col("rank")).otherwise(0.0))


METRICS = f"""{SESSIONS}, m0 AS (SELECT scenario, count(*) AS sample_count, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN hit THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc FROM sessions GROUP BY GROUPING SETS ((scenario), ())),
m1 AS (SELECT *, round(greatest(0, least(1, (11 - mttc) / 10)), 6) AS efficiency FROM m0), metrics AS (SELECT *, round(0.5 * hit_rate + 0.3::DOUBLE * mrr + 0.2::DOUBLE * efficiency, 6) AS technical_score FROM m1)"""


@query(f"WITH {METRICS} SELECT * FROM metrics")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(labelled_sessions(spark, sf_dir))


@query(f"""WITH {METRICS}, old AS (SELECT scenario, round(avg(CASE WHEN hit AND rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN hit AND rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM sessions GROUP BY GROUPING SETS ((scenario), ()))
SELECT m.scenario, m.hit_rate, m.mrr, o.hit_rate AS previous_hit_rate, o.mrr AS previous_mrr, round(m.hit_rate - o.hit_rate, 6) AS delta_hit_rate, round(m.mrr - o.mrr, 6) AS delta_mrr FROM metrics m LEFT JOIN old o ON m.scenario IS NOT DISTINCT FROM o.scenario""")
def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = labelled_sessions(spark, sf_dir)
    shallow = now.withColumn("hit", F.col("hit") & (F.col("rank") <= 5)).withColumn("reciprocal_rank", F.when(F.col("hit"), F.col("reciprocal_rank")).otherwise(0.0))
    return evaluation.compared(evaluation.metrics(now), evaluation.metrics(shallow), "scenario", ["hit_rate", "mrr"])


@query(f"""WITH {SESSIONS}, b AS (SELECT scenario, CASE WHEN hit THEN rank * 6 - 5 END AS r FROM sessions) SELECT scenario, CASE WHEN r IS NULL THEN 'miss' WHEN r <= 3 THEN CAST(r AS VARCHAR) WHEN r <= 10 THEN '4-10' WHEN r <= 50 THEN '11-50' ELSE '51+' END AS bucket, count(*) AS n FROM b GROUP BY ALL""")
def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_sessions(spark, sf_dir).select("scenario", evaluation.rank_bucket(F.col("rank") * 6 - 5).alias("bucket")).groupBy("scenario", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, len(v) AS n, v[CAST(ceil(len(v) * 0.5) AS BIGINT)] AS p50, v[CAST(ceil(len(v) * 0.95) AS BIGINT)] AS p95, v[CAST(ceil(len(v) * 0.99) AS BIGINT)] AS p99 FROM s""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95, 0.99))


@query(f"""WITH m AS (SELECT p_partkey, {MESSAGES} AS message FROM part), h AS (SELECT *, ('0x' || substr(sha256(message), 7, 2) || substr(sha256(message), 5, 2) || substr(sha256(message), 3, 2) || substr(sha256(message), 1, 2))::BIGINT % 3 AS k FROM m)
SELECT p_partkey, k AS style, CASE k WHEN 0 THEN 'um, ' || message WHEN 1 THEN regexp_replace(message, '\\.$', '') || ' if that makes sense' ELSE regexp_replace(message, '\\.$', '') END AS paraphrase FROM h""")
def paraphrase_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = part_messages(spark, sf_dir).withColumn("h", F.sha2("message", 256))
    little = F.concat(*[F.substring("h", i, 2) for i in (7, 5, 3, 1)])
    bare = F.regexp_replace("message", r"\.$", "")
    m = m.withColumn("style", F.conv(little, 16, 10).cast("bigint") % 3)
    return m.select("p_partkey", "style", F.when(F.col("style") == 0, F.concat(F.lit("um, "), "message")).when(F.col("style") == 1, F.concat(bare, F.lit(" if that makes sense"))).otherwise(bare).alias("paraphrase"))


@query(f"""WITH {CARDS} SELECT doc, 'I''m looking for ' || title || CASE doc % 3 WHEN 0 THEN '. A key requirement is: ' || constraints[1] || '.' WHEN 1 THEN '. ' || coalesce(constraints[3], constraints[1]) ELSE ', but I''m still exploring.' END AS opening FROM cards""")
def opening_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenario = F.when(F.col("doc") % 3 == 0, "buying").when(F.col("doc") % 3 == 1, "intent_override").otherwise("browsing")
    return part_cards(spark, sf_dir).select("doc", evaluation.opening(scenario, F.col("title"), F.get("constraints", F.lit(0)), F.coalesce(F.get("constraints", F.lit(2)), F.get("constraints", F.lit(0)))).alias("opening"))


@query(f"""WITH {CARDS}, t AS (SELECT doc, constraints, list_slice(constraints, 1, 1) AS told, ['other', 'budget', 'size', 'color'][doc % 4 + 1] AS attribute FROM cards),
n AS (SELECT *, list_slice(list_filter(constraints, lambda c: NOT list_contains(told, c) AND (attribute = 'other' OR (CASE WHEN regexp_matches(lower(c), 'budget|(\\$|<=|under)\\s*[0-9]') THEN 'budget' WHEN regexp_matches(lower(c), '{lexicon.CONSTRAINT_RULES[1][1]}') THEN 'material' WHEN regexp_matches(lower(c), '{lexicon.CONSTRAINT_RULES[2][1]}') THEN 'color' WHEN regexp_matches(lower(c), '{lexicon.CONSTRAINT_RULES[3][1]}') THEN 'size' ELSE 'x' END) = attribute)), 1, 2) AS next FROM t)
SELECT doc, CASE WHEN len(next) = 0 THEN 'I don''t have an additional preference for ' || attribute || '.' ELSE 'For that, what matters is: ' || array_to_string(next, '; ') || '.' END AS reply FROM n""")
def customer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    attribute = F.element_at(F.array(*map(F.lit, ("other", "budget", "size", "color"))), (F.col("doc") % 4 + 1).cast("int"))
    rows = part_cards(spark, sf_dir).withColumn("attribute", attribute)
    next_ = evaluation.disclosed_next(F.col("constraints"), F.slice("constraints", 1, 1), F.col("attribute"))
    return rows.withColumn("next", next_).select("doc", evaluation.reply(F.col("next"), F.col("attribute"), F.lit(False)).alias("reply"))


@query(f"""WITH {FUSED}, {SESSIONS} SELECT CASE WHEN s.hit THEN 'good' ELSE 'other' END AS judged, count(*) AS n, round(avg(f.rank), 6) AS mean_rank, count(DISTINCT f.query) AS queries FROM fused f JOIN sessions s ON s.doc_id = f.doc GROUP BY 1""")
def judged_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ranking.fused(two_routes(spark, sf_dir)).select("query", "rank", F.col("doc").alias("doc_id"))
    rows = f.join(labelled_sessions(spark, sf_dir).select("doc_id", "hit"), "doc_id")
    return rows.groupBy(F.when(F.col("hit"), "good").otherwise("other").alias("judged")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_distinct("query").alias("queries"))


@query(f"""WITH d AS (SELECT conv_id, turn, lower(trim(text)) AS raw, text FROM conversations) SELECT conv_id, turn, list_contains({listed(lexicon.DECLINES)}, raw) AS exact, length(text) AS chars FROM d""")
def decline_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).isin(*lexicon.DECLINES).alias("exact"), F.length("text").cast("bigint").alias("chars"))


@query(f"""WITH {WHOLE_POOL}, r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM pool), t AS (SELECT c_custkey AS query, (c_custkey * 7) % (SELECT count(*) FROM part) AS doc FROM customer)
SELECT t.query, r.rank, CASE WHEN r.rank IS NULL THEN 'miss' WHEN r.rank <= 3 THEN CAST(r.rank AS VARCHAR) WHEN r.rank <= 10 THEN '4-10' WHEN r.rank <= 50 THEN '11-50' ELSE '51+' END AS bucket FROM t LEFT JOIN r USING (query, doc)""")
def target_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's rank among all products of its turn's pool."""
    turns, products, posted = pool_turns(spark, sf_dir)
    t = customer_targets(spark, sf_dir)
    ranked = retrieval.target_places(t, turns, products, posted)
    return t.join(ranked, ["query", "doc"], "left").select("query", "rank", evaluation.rank_bucket(F.col("rank")).alias("bucket"))
