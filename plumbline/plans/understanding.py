"""Queries of utterance extraction, question choice, turn texts, declines and whole catalog records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import DEFAULT
from plumbline.functions import lexicon, text
from plumbline.operators import catalog as cat
from plumbline.operators import extraction, question, ranking, retrieval
from plumbline.plans.dialogue import VALUES
from plumbline.plans.registry import listed, query, sql_normalise
from plumbline.plans.search import FEATURES, part_features
from plumbline.sources.tables import dealt, materialised, table

#: Phrases that the vocabulary has beside the catalog's names and types.
EXTRA = ("blue", "cotton", "shoes", "t-shirt", "tee", "sneakers", "women", "men")
EXTRA_CATEGORIES = ("shoes", "sneakers", "women")
_SAID = "CASE p_partkey % 6 WHEN 0 THEN concat('Blue <b>', p_name, '</b> in ', p_type) WHEN 1 THEN concat('tee shirt ', p_name, ' please!') WHEN 2 THEN 'Shoe' WHEN 3 THEN concat('something for her, ', p_type) WHEN 4 THEN '' ELSE concat('trainers or ', p_brand) END"


def part_utterances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utterances, vocabulary, categories) about parts."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    said = materialised(p.select(F.col("p_partkey").alias("query"), extraction.utterance(F.expr(_SAID)).alias("text")))  # else each branch normalises, and filters do so before the rows are dealt
    types = F.array(F.lower("p_type"), F.lower(F.concat_ws(" ", "p_type", "p_name")), F.lower("p_name"))
    phrases = lambda more: p.select(F.explode(F.concat(types, F.array(*map(F.lit, more)))).alias("phrase")).distinct()
    return said, phrases(EXTRA), phrases(EXTRA_CATEGORIES)


_ALIASES = ", ".join(f"('{k}', '{x}')" for k, v in lexicon._alias_map().items() for x in v)
_GROUPS = ", ".join(f"('{k}', '{x}')" for k, v in lexicon.PHRASE_GROUPS for x in v)
_PARTS = """types AS (SELECT DISTINCT unnest([lower(p_type), lower(p_type || ' ' || p_name), lower(p_name)]) AS phrase FROM part)"""
UTTERANCES = f"""{_PARTS}, vocabulary AS (SELECT phrase FROM types UNION SELECT unnest({listed(EXTRA)})), categories AS (SELECT phrase FROM types UNION SELECT unnest({listed(EXTRA_CATEGORIES)})),
n0 AS (SELECT p_partkey AS query, {sql_normalise('m')} AS n FROM (SELECT p_partkey, {_SAID} AS m FROM part)), u AS MATERIALIZED (SELECT query, CASE WHEN n = 'shoe' THEN 'shoes' ELSE n END AS n, string_split(CASE WHEN n = 'shoe' THEN 'shoes' ELSE n END, ' ') AS t FROM n0),
grams AS (SELECT DISTINCT query, array_to_string(t[i:i + l - 1], ' ') AS phrase FROM u, generate_series(1, 12) AS a(i), generate_series(1, 8) AS b(l) WHERE n <> '' AND i + l - 1 <= len(t)),
aliases(token, term) AS (VALUES {_ALIASES}), groups(held, term) AS (VALUES {_GROUPS}), words AS (SELECT query, unnest(t) AS token FROM u WHERE n <> ''),
expanded AS (SELECT query, coalesce(term, token) AS phrase FROM words LEFT JOIN aliases USING (token) UNION SELECT query, term FROM u JOIN groups ON contains(' ' || n || ' ', ' ' || held || ' ') UNION SELECT query, n FROM u WHERE n <> ''),
lexical AS (SELECT DISTINCT query, phrase FROM (SELECT * FROM grams UNION ALL SELECT * FROM expanded) WHERE phrase IN (SELECT phrase FROM vocabulary)),
category AS (SELECT query, phrase, CASE tier WHEN 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM (SELECT query, phrase, 0 AS tier FROM grams WHERE length(phrase) >= 3 UNION ALL SELECT query, phrase, 1 FROM expanded)
  WHERE phrase IN (SELECT phrase FROM categories) AND NOT list_has_any(string_split(phrase, ' '), {listed(lexicon.MEN + lexicon.WOMEN)}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, length(phrase) DESC, phrase) = 1),
gender AS (SELECT query, CASE WHEN list_has_any(t, {listed(lexicon.MEN)}) THEN 'men' ELSE 'women' END AS phrase FROM u WHERE list_has_any(t, {listed(lexicon.MEN)}) <> list_has_any(t, {listed(lexicon.WOMEN)})),
found AS (SELECT query, phrase, 'exact' AS source, 1.0::DOUBLE AS confidence FROM lexical UNION SELECT query, phrase, 'exact', 1.0 FROM gender UNION ALL SELECT query, phrase, 'category', confidence FROM category)"""


@query(f"WITH {UTTERANCES} SELECT query, phrase, source, confidence FROM found")
def constraint_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(*part_utterances(spark, sf_dir)).select("query", "phrase", "source", "confidence")


@query(f"""WITH {UTTERANCES}, o AS (SELECT u.query, count(w.token) AS n, count(w.token) FILTER (w.token NOT IN (SELECT phrase FROM vocabulary)) AS unknown FROM u LEFT JOIN words w USING (query) GROUP BY u.query), e AS (SELECT query, count(*) AS k FROM found WHERE source = 'exact' GROUP BY query)
SELECT query, round(CASE WHEN n > 0 THEN unknown / n ELSE 0 END, 6) AS ratio, coalesce(k, 0) < {DEFAULT.semantic_fallback_threshold} OR (n > 0 AND unknown / n >= {DEFAULT.oov_token_ratio}::DOUBLE) AS needs FROM o LEFT JOIN e USING (query)""")
def semantic_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which utterances need the nearest phrases by meaning."""
    said, vocabulary, categories = part_utterances(spark, sf_dir)
    found = extraction.extracted(said, vocabulary, categories)
    return extraction.needs_meaning(found, extraction.unknown_share(said, vocabulary)).select("query", F.round("ratio", 6).alias("ratio"), "needs")


@query(f"""WITH h AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS confidence FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, doc) AS nth FROM h QUALIFY nth <= {DEFAULT.semantic_k}) SELECT query, 'phrase ' || doc AS phrase, 'semantic' AS source, least(1.0, confidence) AS confidence FROM r WHERE confidence >= {DEFAULT.semantic_cosine_floor}""")
def semantic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for phrases; those whose id is divisible by 100, for utterances."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("phrase"), F.col("embedding").alias("vector"))
    got = extraction.nearest_phrases(v.where("doc % 100 = 0").select(F.col("doc").alias("query"), "vector"), v)
    return got.select("query", "phrase", "source", "confidence")


_STATES = "CASE length(p_type) % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['other', 'other'] WHEN 2 THEN ['other', 'other', 'color', 'size'] ELSE ['other', 'other'] END AS asked, CASE length(p_type) % 4 WHEN 3 THEN p_type END AS category, CASE length(p_type) % 4 WHEN 3 THEN ['size'] ELSE []::VARCHAR[] END AS slots"


@query(f"""WITH {VALUES}, st AS (SELECT p_type AS query, {_STATES} FROM (SELECT DISTINCT p_type FROM part)), h AS (SELECT p_type AS query, ln(count(*)) AS entropy, count(*) AS n FROM part GROUP BY 1), c AS (SELECT query, attribute, value, count(*) AS c FROM v GROUP BY ALL),
g AS (SELECT query, attribute, round(CASE WHEN sum(c) < 2 THEN 0 ELSE greatest(0, max(entropy) - sum(c * ln(c)) / sum(c)) END, 6) AS gain, max(entropy) AS entropy FROM c JOIN h USING (query) GROUP BY query, attribute),
b AS (SELECT query, attribute, gain, entropy FROM g JOIN st USING (query) WHERE attribute NOT IN ('other', 'category', 'brand') AND NOT list_contains(asked, attribute) AND NOT list_contains(slots, attribute)
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY gain DESC, list_position({listed(DEFAULT.ask_attributes)}, attribute)) = 1),
a AS (SELECT st.*, CASE WHEN n >= 2 AND len(list_filter(asked, lambda x: x = 'other')) < 2 THEN 'other' WHEN category IS NOT NULL AND len(slots) > 0 THEN NULL WHEN b.entropy >= ln(3) AND gain >= 0.15 THEN attribute END AS ask FROM st JOIN h USING (query) LEFT JOIN b USING (query))
SELECT query, ask, CASE WHEN ask IS NOT NULL THEN 'Could you share a preferred ' || ask || '?' WHEN category IS NOT NULL OR len(slots) > 0 THEN 'Here are the closest matches so far.' ELSE 'Tell me a product type, color, or material.' END AS message FROM a""")
def question_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next question of a session for each type, in four states, and what is said with it."""
    p = table(spark, sf_dir, "part")
    color = F.nullif(F.regexp_extract("p_name", "(red|blue)", 1), F.lit(""))
    values = {"brand": F.lower("p_brand"), "size": F.floor(F.col("p_size") / 10).cast("string"), "budget": lexicon.price_bucket(F.col("p_retailprice")), "color": color}
    rows = p.select(F.col("p_type").alias("query"), F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in values.items()])).alias("x")).select("query", "x.*").where("value is not null")
    sizes = p.groupBy(F.col("p_type").alias("query")).agg(F.log(F.count(F.lit(1)).cast("double")).alias("entropy"), F.count(F.lit(1)).alias("n"))
    k, strings = F.length("query") % 4, lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    asked = F.when(k == 0, strings()).when(k == 2, strings("other", "other", "color", "size")).otherwise(strings("other", "other"))
    states = sizes.select("query", "n", asked.alias("asked"), strings().alias("declined"), F.when(k == 3, strings("size")).otherwise(strings()).alias("slots"), F.when(k == 3, F.col("query")).alias("category"))
    out = question.choice(states, question.gains(rows, sizes.select("query", "entropy"))).join(states, "query")
    return out.select("query", "ask", question.message(F.col("ask"), F.col("category").isNotNull() | (F.size("slots") > 0)).alias("message"))


@query("""SELECT p_partkey, concat_ws('. ', CASE WHEN p_partkey % 4 <> 0 THEN p_type END, nullif(array_to_string(list_filter([lower(p_brand), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END], lambda x: x <> ''), ' '), ''), CASE WHEN p_partkey % 5 <> 0 THEN 'show me more' END) AS text,
  CASE WHEN p_partkey % 5 = 0 THEN 'women' WHEN p_partkey % 3 = 0 THEN 'men' END AS gender FROM part""")
def dense_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    phrases = F.array(F.lower("p_brand"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")))
    made = retrieval.query_text(F.when(k % 4 != 0, F.col("p_type")), phrases, F.when(k % 5 != 0, "show me more").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("text"), retrieval.wanted_gender(F.when(k % 3 == 0, "mens"), F.when(k % 5 == 0, "for her")).alias("gender"))


_TERMS = f"""x AS (SELECT p_partkey AS query, unnest([lower(p_type) || ' trainers', 'tee shirt', lower(p_name)]) AS said FROM part), aliases(token, term) AS (VALUES {_ALIASES}), groups(held, term) AS (VALUES {_GROUPS}),
terms AS (SELECT query, coalesce(term, token) AS term FROM (SELECT query, unnest(string_split(said, ' ')) AS token FROM x) LEFT JOIN aliases USING (token) UNION SELECT query, term FROM x JOIN groups ON contains(' ' || said || ' ', ' ' || held || ' ') UNION SELECT query, said FROM x)"""


@query(f"WITH {_TERMS} SELECT query, term FROM terms")
def session_term_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.session_terms(F.concat(F.lower("p_type"), F.lit(" trainers")), F.array(F.lit("tee shirt")), F.lower("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.explode(made).alias("term"))


_ANSWERS = "CASE c_custkey % 6 WHEN 0 THEN 'I really don''t care.' WHEN 1 THEN concat('skip ', c_custkey) WHEN 2 THEN ' What? ' WHEN 3 THEN 'blue, please' WHEN 4 THEN 'No idea, whatever' ELSE 'skipping along' END"


@query(f"""WITH a AS (SELECT c_custkey, {_ANSWERS} AS m FROM customer), n AS (SELECT *, ' ' || {sql_normalise('m')} || ' ' AS p FROM a)
SELECT c_custkey, list_contains({listed(lexicon.DECLINES)}, lower(trim(m))) OR {' OR '.join(f"contains(p, ' {c.replace(chr(39), ' ')} ')" for c in lexicon.DECLINE_CUES)} AS declines FROM n""")
def declines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that decline a question, as a whole or by a cue."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.is_decline(F.expr(_ANSWERS)).alias("declines"))


@query("""SELECT 'P' || p_partkey AS parent_asin, p_name || ' for men' AS title, p_type AS leaf_category, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 4.5 END AS avg_rating, p_size::BIGINT AS rating_count, p_partkey % 3 = 0 AS is_sparse,
  CASE WHEN p_partkey % 2 = 0 THEN 'women' ELSE 'men' END AS department, true AS by_type, true AS by_brand, (p_name || ' for men' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' for ' || lower(p_type) || ' wear by ' || p_brand END || ' brand ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' department ladies' ELSE '' END || ' ' || 'Made well & fine.' || ' Parts ' || p_type || ' ' || p_brand) AS said FROM part WHERE p_partkey % 7 <> 0""")
def product_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records made of parts, through the whole cleaning of a catalog."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    k, brand, kind = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    text_ = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    records = p.select(
        F.when(k % 7 != 0, text_("P", k.cast("string"))).otherwise(" ").alias("parent_asin"), F.lit(None).cast("string").alias("asin"), text_(" ", F.col("p_name"), " for men").alias("title"),
        F.when(k % 3 == 0, "[]").otherwise(text_('["for ', F.lower(kind), " wear by ", brand, '"]')).alias("features"), F.lit('["Description", "Made <b>well</b> &amp; fine."]').alias("description"), text_("$", F.col("p_retailprice").cast("string")).alias("price"),
        text_('["Parts", "', kind, '"]').alias("categories"), F.when(k % 2 == 0, text_('{"Brand": "', brand, '", "Department": "ladies"}')).otherwise(text_('{"Brand": "', brand, '", "Fit": "n/a"}')).alias("details"),
        F.when(k % 4 == 0, "n/a").otherwise("4.5").alias("average_rating"), F.col("p_size").cast("string").alias("rating_number"), brand.alias("store"),
    )
    made = cat.products(records).withColumn("said", F.regexp_replace(cat.searchable_text(), r"\s+", " "))
    by = lambda x: F.array_contains("attr_phrases", text.normalise(x))
    return made.select("parent_asin", "title", "leaf_category", "price", "avg_rating", "rating_count", "is_sparse", "department", by(F.col("leaf_category")).alias("by_type"), by(F.col("store")).alias("by_brand"), "said")


@query(f"""WITH {FEATURES}, scored AS (SELECT query, doc, fused, round(0.005::DOUBLE * log_count + fused + 2.0 * coverage + 0.6::DOUBLE * confidence + 0.8::DOUBLE * leaf_exact + 0.15::DOUBLE * path_overlap + 0.4::DOUBLE * title_overlap + 1.8::DOUBLE * gender_match - 0.15::DOUBLE * sparse - 1.5 * unmatched - 4.0 * gender_mismatch, 6) AS rescored,
  row_number() OVER (PARTITION BY query ORDER BY fused DESC, doc) AS rank FROM features), ahead AS (SELECT query, CASE WHEN max(fused) FILTER (rank = 2) IS NULL THEN 1.0 ELSE round((max(fused) FILTER (rank = 1) - max(fused) FILTER (rank = 2)) / greatest(max(fused) FILTER (rank = 1), 1e-9), 6) END AS margin FROM scored GROUP BY query),
last AS (SELECT query, doc, CASE WHEN margin > {DEFAULT.margin_high}::DOUBLE THEN fused ELSE rescored END AS final FROM scored JOIN ahead USING (query)) SELECT query, doc, final, row_number() OVER (PARTITION BY query ORDER BY final DESC, doc) AS final_rank FROM last""")
def rerank_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristic's order, but where the first candidate is far ahead already."""
    rows = retrieval.best(part_features(spark, sf_dir).withColumn("rescored", ranking.heuristic(F.lit(True))).withColumn("score", F.col("fused")), DEFAULT.n_fuse, ["query"])
    return ranking.reranked(rows.select("query", "doc", "score", "rank", "rescored"), ranking.margins(rows), "cascade")
