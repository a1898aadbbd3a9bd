"""Queries that clean records and build indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lexicon, text
from plumbline.operators import catalog as cat
from plumbline.plans.registry import CATALOG, listed, query, sql_normalise
from plumbline.sources.tables import cached, dealt, file_path, shared_folder, table


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: doc, title, store, bucket, size, price, cnt, stars."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("s"))
    p = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"), F.col("p_type").alias("bucket"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.coalesce("n", F.lit(0)).alias("cnt"), F.coalesce("s", F.lit(0.0)).alias("stars"))


@query(f"SELECT doc_id, {sql_normalise('text')} AS phrase FROM documents")
def normalise_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("phrase"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM pages""")
def strip_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.collapse(text.strip_html(F.col("html"))).alias("plain"))


def _dirty_price() -> Column:
    whole = F.floor("p_retailprice").cast("bigint").cast("string")
    return F.element_at(F.array(F.concat(F.lit("$"), whole, F.lit(".50")), F.concat(F.lit("$"), whole, F.lit(" - $9999")), F.concat(F.lit("1,"), whole), F.lit("None")), (F.col("p_partkey") % 4 + 1).cast("int"))


@query("""WITH d AS (SELECT p_partkey, [concat('$', w, '.50'), concat('$', w, ' - $9999'), concat('1,', w), 'None'][p_partkey % 4 + 1] AS raw
    FROM (SELECT p_partkey, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS w FROM part))
SELECT p_partkey, raw, CASE WHEN lower(raw) NOT IN ('none', 'nan', 'null', 'n/a', 'na', 'nil', '') THEN TRY_CAST(nullif(regexp_extract(replace(raw, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) END AS price FROM d""")
def price_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", _dirty_price().alias("raw")).withColumn("price", text.price(F.col("raw")))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, concat('k: ', json_extract_string(props, '$.k')) AS flat FROM events""")
def details_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", text.details(F.col("props")).alias("d"))
    return rows.select("event_id", F.element_at("d", "k").alias("k"), F.get(text.key_values(F.col("d")), F.lit(0)).alias("flat"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_words, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS words FROM documents""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_set(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query(f"""WITH t AS (SELECT item_id, string_split({sql_normalise('text')}, ' ') AS w FROM benchmark),
g AS (SELECT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM t, (SELECT unnest([2, 3, 4]) AS n) s, generate_series(1, greatest(len(w), 1)) AS x(i) WHERE i + n - 1 <= len(w) AND w <> [''])
SELECT gram, n, count(DISTINCT item_id) AS df, count(*) AS cf FROM g GROUP BY gram, n""")
def ngram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.ngrams(text.normalise(F.col("text")), 2, 4)).alias("gram"))
    return rows.groupBy("gram").agg(F.count_distinct("item_id").alias("df"), F.count(F.lit(1)).alias("cf")).withColumn("n", text.token_count(F.col("gram")))


def _sql_any(words) -> str:
    return f"list_has_any(t, {listed(words)})"


@query(f"""WITH p AS (SELECT p_partkey, p_name, string_split(lower(p_name), ' ') AS t, replace(replace(lower(p_name), ' ', ''), '-', '') AS j FROM part)
SELECT p_partkey, CASE WHEN {_sql_any(lexicon.COLORS)} OR list_contains({listed(lexicon.COLORS)}, j) THEN 'color' WHEN {_sql_any(lexicon.MATERIALS)} OR list_contains({listed(lexicon.MATERIALS)}, j) THEN 'material'
  WHEN {_sql_any(lexicon.SIZES)} OR list_contains({listed(lexicon.SIZES)}, j) OR len(list_filter(list_concat(t, [j]), lambda x: regexp_matches(x, '{lexicon.SIZE_PATTERN}'))) > 0 THEN 'size'
  WHEN {_sql_any(lexicon.FEATURES)} OR list_contains({listed(lexicon.FEATURES)}, j) THEN 'feature' WHEN {_sql_any(lexicon.USES)} OR list_contains({listed(lexicon.USES)}, j) THEN 'use_case'
  WHEN {_sql_any(lexicon.FITS + lexicon.STYLES)} OR list_contains({listed(lexicon.FITS + lexicon.STYLES)}, j) THEN 'style' END AS attribute FROM p""")
def slot_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lexicon.guess_attribute(F.col("p_name")).alias("attribute"))


def _addressed() -> Column:
    """A customer's segment with a word for whom it is."""
    who = F.array(*map(F.lit, ("for him", "Women's", "ladies and men", "kids", "mens wear", "gift for her")))
    return F.concat_ws(" ", F.element_at(who, (F.col("c_custkey") % 6 + 1).cast("int")), F.lower("c_mktsegment"))


@query(f"""WITH c AS (SELECT c_custkey, concat(['for him', 'Women''s', 'ladies and men', 'kids', 'mens wear', 'gift for her'][c_custkey % 6 + 1], ' ', lower(c_mktsegment)) AS phrase FROM customer),
t AS (SELECT *, replace(replace(lower(phrase), '''', ''), '-', '') AS p FROM c),
g AS (SELECT *, list_has_any(string_split(p, ' '), {listed(lexicon.MEN)}) OR {' OR '.join(f"contains(' ' || p || ' ', ' {x} ')" for x in lexicon.MEN_PHRASES)} AS m,
  list_has_any(string_split(p, ' '), {listed(lexicon.WOMEN)}) OR {' OR '.join(f"contains(' ' || p || ' ', ' {x} ')" for x in lexicon.WOMEN_PHRASES)} AS w FROM t)
SELECT c_custkey, phrase, CASE WHEN m AND NOT w THEN 'men' WHEN w AND NOT m THEN 'women' END AS gender FROM g""")
def gender_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", _addressed().alias("phrase"))
    return rows.withColumn("gender", lexicon.canonical_gender(F.col("phrase")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'clothing item' WHEN p_partkey % 5 = 1 THEN p_type ELSE concat(p_type, ' ', p_name) END AS category FROM part""")
def coarse_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, F.array(F.lit("Clothing, Clothing Shoes & Jewelry"))).when(k == 1, F.array(F.lit("Clothing"), F.col("p_type"))).when(k == 2, F.array(F.concat(F.lit("Root, "), F.col("p_type"), F.lit(", "), F.col("p_name")))).otherwise(F.array(F.lit("clothing"), F.lit("Parts"), F.col("p_type"), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", text.coarse_category(path).alias("category"))


def part_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, title, bucket and the ordered constraints of every part; made once for the files, and stored."""
    p = table(spark, sf_dir, "part")
    entries = F.array(F.concat(F.lit("brand: "), "p_brand"), F.concat(F.lit("size: "), F.col("p_size").cast("string")))
    price = F.floor("p_retailprice").cast("bigint").cast("string")
    made = cat.card_constraints(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.array(F.lower("p_type")), entries, price)
    # parts that are alike get one card; by a key that is never null, so that no filter of nulls makes it below an exchange
    keyed = p.select(F.col("p_partkey").alias("doc"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", F.coalesce(F.md5(F.to_json(F.struct("p_name", "p_brand", "p_type", "p_size", price.alias("price")))), F.lit("")).alias("card"))
    one = keyed.groupBy("card").agg(*[F.first(c).alias(c) for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")])
    made_once = lambda: dealt(one, "card").select("card", F.col("p_name").alias("title"), F.col("p_type").alias("bucket"), made.alias("constraints"))
    cards = lambda: dealt(keyed.select("doc", "card"), "card").hint("merge").join(made_once(), "card").select("doc", "title", "bucket", "constraints")
    return cached(spark, file_path(f"{shared_folder(spark)}/cards", "parts-1", p), cards)


def customer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc): each customer, and the product that their number stands for. A file of few bytes may hold very many of them,
    so what is joined with them is exchanged, not sent whole because of the file's size."""
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(F.broadcast(n)).select(F.col("c_custkey").alias("query"), (F.col("c_custkey") * 7 % F.col("n")).alias("doc")).hint("merge")


CARDS = f"""cards AS (SELECT p_partkey AS doc, p_name AS title, p_type AS bucket, list_filter(list_concat(CASE WHEN m <> '' THEN [m] ELSE [] END, CASE WHEN c <> '' AND m <> '' THEN ['color: ' || c] ELSE [] END, [lower(p_type)],
    CASE WHEN c <> '' AND m = '' THEN ['color: ' || c] ELSE [] END, ['brand: ' || p_brand, 'size: ' || CAST(p_size AS VARCHAR), 'budget around $' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)]), lambda x: x <> '') AS constraints
  FROM (SELECT *, lower(regexp_extract(concat(p_name, ' ', p_brand, ' ', p_type), '(?i)\\b({'|'.join(cat.CARD_MATERIALS)})\\b', 1)) AS m, lower(regexp_extract(concat(p_name, ' ', p_brand, ' ', p_type), '(?i)\\b({'|'.join(cat.CARD_COLORS)})\\b', 1)) AS c FROM part))"""


@query(f"""WITH {CARDS} SELECT doc, title AS target_category, array_to_string(list_slice(constraints, 1, 2), ' | ') AS hard, array_to_string(CASE WHEN len(constraints) > 2 THEN list_slice(constraints, 3, 4) ELSE list_slice(constraints, 1, 1) END, ' | ') AS soft FROM cards""")
def intent_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_cards(spark, sf_dir).select("doc", cat.intent_card(F.col("constraints"), F.col("title")).alias("c"))
    return rows.select("doc", F.col("c.target_category").alias("target_category"), F.array_join("c.hard_constraints", " | ").alias("hard"), F.array_join("c.soft_preferences", " | ").alias("soft"))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS phrase FROM documents)
SELECT phrase, count(*) AS df, round(ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0) / (count(*) + 1.0)) + 1, 6) AS idf FROM t GROUP BY phrase""")
def phrase_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.select(F.count_distinct("doc_id").alias("n"))
    posted = docs.select(F.col("doc_id").alias("doc"), F.explode(text.word_set(F.col("text"))).alias("phrase"))
    return cat.smoothed_idf(posted, n).select("phrase", "df", F.round("idf", 6).alias("idf"))


@query("""SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    copies = rows.groupBy(F.col("digest").alias("of")).agg(F.count(F.lit(1)).alias("copies"))
    return cat.first_seen(rows, "digest", "doc_id").join(copies, F.col("digest").eqNullSafe(F.col("of"))).select("digest", "doc_id", "copies")


@query(f"""WITH {CATALOG} SELECT doc, row_number() OVER (ORDER BY cnt DESC, stars DESC, doc) AS rank, round(0.05 * ln(1 + cnt), 6) AS boost FROM catalog""")
def popularity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat.popularity(catalog(spark, sf_dir), "doc", "cnt", "stars")
    return rows.select("doc", "rank", F.round("boost", 6).alias("boost"))


@query(f"""WITH c AS (SELECT {sql_normalise('p_type')} AS phrase, 'type' AS level FROM part UNION ALL SELECT {sql_normalise("concat(p_type, ' ', p_name)")}, 'path' FROM part)
SELECT phrase, level, count(*) AS n, length(phrase) AS chars FROM c GROUP BY ALL""")
def category_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(text.normalise(F.col("p_type")).alias("phrase"), F.lit("type").alias("level")).unionByName(p.select(text.normalise(F.concat_ws(" ", "p_type", "p_name")).alias("phrase"), F.lit("path").alias("level")))
    return rows.groupBy("phrase", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("chars", F.length("phrase").cast("bigint"))


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE p_brand END AS store, CASE WHEN p_size < 10 THEN '' ELSE p_type END AS category FROM part)
SELECT 'title' AS field, count(*) FILTER (title IS NULL OR title = '') AS missing, count(*) FILTER (title = 'None') AS literal_none, count(*) AS total FROM p
UNION ALL SELECT 'store', count(*) FILTER (store IS NULL OR store = ''), count(*) FILTER (store = 'None'), count(*) FROM p
UNION ALL SELECT 'category', count(*) FILTER (category IS NULL OR category = ''), count(*) FILTER (category = 'None'), count(*) FROM p""")
def missingness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, "None").otherwise(F.col("p_brand")).alias("store"), F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type")).alias("category"))
    return cat.missingness(p, ["title", "store", "category"])


@query("""WITH d AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part) SELECT w AS term, count(*) AS cf, count(DISTINCT p_partkey) AS df,
  CASE WHEN list_contains(['a','an','and','are','as','at','be','but','by','for','from','i','in','is','it','me','my','of','on','or','please','some','that','the','this','to','want','with','would','you','looking'], w) OR length(w) < 2 THEN true ELSE false END AS stop FROM d GROUP BY w""")
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.count_distinct("p_partkey").alias("df")).withColumn("stop", F.col("term").isin(*text.BASELINE_STOP) | (F.length("term") < 2))


@query(f"""WITH {CARDS}, c AS (SELECT doc, unnest(constraints) AS value FROM cards)
SELECT doc, value, CASE WHEN regexp_matches(lower(value), 'budget|(\\$|<=|under)\\s*[0-9]') THEN 'budget' WHEN regexp_matches(lower(value), '{lexicon.CONSTRAINT_RULES[1][1]}') THEN 'material' WHEN regexp_matches(lower(value), '{lexicon.CONSTRAINT_RULES[2][1]}') THEN 'color'
  WHEN regexp_matches(lower(value), '{lexicon.CONSTRAINT_RULES[3][1]}') THEN 'size' WHEN regexp_matches(lower(value), '{lexicon.CONSTRAINT_RULES[4][1]}') THEN 'style' WHEN regexp_matches(lower(value), '{lexicon.CONSTRAINT_RULES[5][1]}') THEN 'use_case' ELSE 'feature' END AS class FROM c""")
def constraint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_cards(spark, sf_dir).select("doc", F.explode("constraints").alias("value"))
    return rows.withColumn("class", lexicon.classify_constraint(F.col("value")))
