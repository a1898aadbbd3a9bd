"""Queries that retrieve, fuse and rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import DEFAULT
from plumbline.functions import text
from plumbline.operators import catalog as cat
from plumbline.operators import alike, dense, encoder, lexical, pool, ranking, recovery, retrieval
from plumbline.plans.cleaning import CARDS, catalog, customer_targets, part_cards
from plumbline.plans.registry import CATALOG, listed, query
from plumbline.sources.tables import cached, dealt, file_path, materialised, shared_folder, table

K = 10


def _words(text_: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_), F.lit("[a-z0-9]+"), F.lit(0))


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical index of the documents; it is written once for their files, and read by every query after."""
    docs = table(spark, sf_dir, "documents")
    at = file_path(f"{shared_folder(spark)}/lexical", "documents-1", docs)
    return lexical.stored(spark, at, docs.select(F.col("doc_id").alias("doc"), "text"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))


def lexical_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.bm25(document_index(spark, sf_dir), _asked(spark, sf_dir), k)


BM25 = """t AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), dl AS (SELECT doc, len(w) AS dl FROM t),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM t) GROUP BY ALL), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
d AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n WHERE term IN (SELECT term FROM q) GROUP BY term, n),
lexical AS (SELECT query, doc, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN d USING (term) JOIN tf USING (term) JOIN dl USING (doc), n GROUP BY query, doc),
lexical_hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM lexical WHERE score > 0)"""


@query(f"WITH {BM25} SELECT query, doc, score, rank FROM lexical_hits WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir, K).select("query", "doc", "score", "rank")


@query()
def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By query, the blocks of its terms and how many of them were opened for the best K."""
    rows = lexical.bm25_cells(document_index(spark, sf_dir), _asked(spark, sf_dir), K)
    return rows.where("doc is null").groupBy("query").agg(F.sum("blocks").alias("blocks"), F.sum("opened").alias("opened"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.matched(document_index(spark, sf_dir), _asked(spark, sf_dir).withColumn("confidence", F.lit(1.0)))


EXACT = """p AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS phrase FROM documents),
i AS (SELECT phrase, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM p GROUP BY phrase),
e AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS phrase FROM benchmark),
exact AS (SELECT query, doc, round(sum(idf), 6) AS score FROM e JOIN p USING (phrase) JOIN i USING (phrase) GROUP BY query, doc),
exact_hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM exact WHERE score > 0)"""


@query(f"WITH {EXACT} SELECT query, doc, score, rank FROM exact_hits WHERE rank <= 50")
def exact_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_hits(spark, sf_dir).select("query", "doc", "score", "rank")


@query(f"""WITH {CARDS}, p AS (SELECT DISTINCT doc, unnest(constraints) AS phrase FROM cards), d AS (SELECT phrase, count(*) AS df FROM p GROUP BY phrase), q AS (SELECT c_custkey AS query, unnest(list_slice(constraints, 1, 4)) AS phrase FROM customer JOIN cards ON doc = (c_custkey * 7) % (SELECT count(*) FROM part)),
h AS (SELECT query, doc, round(sum(CASE WHEN df > 50 THEN 0.25::DOUBLE ELSE 20.0::DOUBLE / df END), 6) AS score FROM (SELECT DISTINCT * FROM q) JOIN d USING (phrase) JOIN p USING (phrase) GROUP BY query, doc)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h QUALIFY rank <= {K}""")
def intent_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = part_cards(spark, sf_dir)
    return retrieval.rare_constraints_of(customer_targets(spark, sf_dir), cards.select("doc", "constraints"), 4, K).select("query", "doc", "score", "rank")


FIELD_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}
#: Distinct terms of a message that are searched for.
MOST_TERMS = 40
_FIELDS = {"title": "p_name", "categories": "p_type", "features": "concat('for ', p_type, ' size ', p_size)", "details": "concat('brand ', p_brand)", "store": "p_brand", "description": "concat(p_name, ' by ', p_brand)"}
_MESSAGE = "concat('I am looking for a ', p_type, ' ', p_name, ' by ', p_brand, ', please!')"


PART_FIELDS = f"""f AS ({' UNION ALL '.join(f"SELECT p_partkey AS doc, {FIELD_WEIGHTS[k]}::DOUBLE AS w, regexp_extract_all(lower({x}), '[a-z0-9]+') AS t FROM part" for k, x in _FIELDS.items())}),
dl AS (SELECT doc, sum(len(t)) AS dl FROM f GROUP BY doc), tf AS (SELECT doc, term, sum(w) AS tf FROM (SELECT doc, w, unnest(t) AS term FROM f) GROUP BY ALL), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
d AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n)"""


@query(f"""WITH {PART_FIELDS}, m AS (SELECT DISTINCT {_MESSAGE} AS query FROM part), a AS (SELECT query, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({listed(text.BASELINE_STOP)}, x)) AS terms FROM m),
q AS (SELECT query, unnest(list_filter(terms, lambda x, i: list_position(terms, x) = i)[1:{MOST_TERMS}]) AS term FROM a),
h AS (SELECT query, doc, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN d USING (term) JOIN tf USING (term) JOIN dl USING (doc), n GROUP BY query, doc)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h WHERE score > 0 QUALIFY rank <= {K}""")
def fts_weighted_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without stop words and single letters, at most MOST_TERMS terms each, against six weighted fields."""
    asked = table(spark, sf_dir, "part").select(F.expr(_MESSAGE).alias("query")).distinct().select("query", F.explode(F.slice(F.array_distinct(text.query_terms(F.col("query"))), 1, MOST_TERMS)).alias("term"))
    return part_hits(spark, sf_dir, asked, K).select("query", "doc", "score", "rank")


def part_hits(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    """BM25 over the parts' weighted fields; parts that are alike are indexed as one, and the index is written once."""
    p = table(spark, sf_dir, "part")
    fields = [(weight, _words(F.expr(_FIELDS[f]))) for f, weight in FIELD_WEIGHTS.items()]
    # a term counts its field's weight for each occurrence
    docs = dealt(p, "p_partkey").select(F.col("p_partkey").alias("doc"), F.concat(*[t for _, t in fields]).alias("terms"), F.concat(*[F.array_repeat(F.lit(w), F.size(t)) for w, t in fields]).alias("weights"))
    at = lambda version: file_path(f"{shared_folder(spark)}/lexical", version, p)
    profiles = cached(spark, at("part-profiles-1"), lambda: alike.contents(docs))
    index = lexical.stored(spark, at("part-fields-2"), dealt(profiles.select(F.col("id").alias("doc"), "terms", "weights"), "doc"))
    return alike.bm25(profiles, index, docs, asked, k, 1.2, 0.75)


#: What a customer asks for: a budget, and every other one a size; their product's name and brand is what they say.
_RARE = "budget around $"


@query(f"""WITH {CARDS}, {PART_FIELDS}, c AS (SELECT c_custkey AS query, doc, title, constraints FROM customer JOIN cards ON doc = (c_custkey * 7) % (SELECT count(*) FROM part)),
q AS (SELECT query, phrase, CASE WHEN phrase LIKE 'size:%' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM (SELECT query, unnest(constraints) AS phrase FROM c) WHERE phrase LIKE '{_RARE}%' OR (phrase LIKE 'size:%' AND query % 2 = 0)),
p AS (SELECT DISTINCT doc, unnest(constraints) AS phrase FROM cards), i AS (SELECT phrase, ln(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM p GROUP BY phrase),
w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence, phrase) AS weak, count(*) OVER (PARTITION BY query) AS told FROM q), l AS (SELECT w.*, level FROM w, generate_series(0, 3) AS g(level) WHERE weak > level),
s AS (SELECT query, level, doc, round(sum(confidence * idf), 6) AS score FROM l JOIN p USING (phrase) JOIN i USING (phrase) GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY query, level ORDER BY score DESC, doc) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50),
v AS (SELECT c.query, level, least(coalesce(max(told), 0), 3) AS may FROM c LEFT JOIN w USING (query), generate_series(0, 3) AS g(level) GROUP BY ALL),
z AS (SELECT v.query, v.level, may, count(e.doc) AS found FROM v LEFT JOIN e USING (query, level) GROUP BY ALL), y AS (SELECT query, min(level) AS level, arg_min(found, level) AS found FROM z WHERE found >= {K} OR level >= may GROUP BY query),
o AS (SELECT query, doc, level, rank AS place FROM e JOIN y USING (query, level)),
t AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(concat(p_name, ' ', p_brand)), '[a-z0-9]+')) AS term FROM c JOIN part ON p_partkey = doc),
h AS (SELECT query, doc, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM t JOIN y USING (query) JOIN d USING (term) JOIN tf USING (term) JOIN dl USING (doc), n WHERE found < {K} GROUP BY query, doc),
x AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h WHERE score > 0 QUALIFY rank <= 200),
a AS (SELECT x.query, x.doc, y.level, y.found + row_number() OVER (PARTITION BY x.query ORDER BY x.rank) AS place FROM x JOIN y USING (query) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query = x.query AND o.doc = x.doc))
SELECT query, doc, 'constraints' AS tier, CAST(level AS INTEGER) AS level, place FROM o UNION ALL SELECT query, doc, 'lexical', CAST(level AS INTEGER), place FROM a WHERE place <= {K}""")
def recovery_with_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ask for a budget (and a size): exact phrases, then fewer of them, then words from the stored index."""
    cards = part_cards(spark, sf_dir)
    posted = cat.postings(cards, "doc", "constraints").select("phrase", "doc")
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    idf = materialised(cat.smoothed_idf(posted, n))
    targets = materialised(customer_targets(spark, sf_dir))
    size = F.col("phrase").startswith("size:")
    asked = targets.join(cards, "doc").select("query", F.explode("constraints").alias("phrase")).where(F.col("phrase").startswith(_RARE) | (size & (F.col("query") % 2 == 0)))
    asked = asked.withColumns({"confidence": F.when(size, 0.5).otherwise(1.0), "category": F.lit(None).cast("string")})
    said = targets.join(table(spark, sf_dir, "part"), F.col("doc") == F.col("p_partkey")).select("query", F.explode(F.array_distinct(_words(F.concat_ws(" ", "p_name", "p_brand")))).alias("term"))
    last = lambda short: part_hits(spark, sf_dir, said.join(short, "query", "left_semi"), DEFAULT.k_lexical)
    return recovery.staged(targets, asked, lambda some: retrieval.exact_phrases(some, posted, idf), last, K)


@query(f"""WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT query, vec_id AS doc, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h QUALIFY rank <= {K}""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return retrieval.nearest(v.where("doc % 100 = 0").withColumnRenamed("doc", "query"), v, K).select("query", "doc", "score", "rank")


def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoder that is learnt from the documents, stored for their files."""
    docs = table(spark, sf_dir, "documents")
    at = file_path(f"{shared_folder(spark)}/encoder", "documents-1", docs)
    return cached(spark, at, lambda: encoder.trained(lexical.split(docs.select(F.col("doc_id").alias("id"), "text"))))


@query()
def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against documents by meaning: the dense route over texts."""
    terms = term_vectors(spark, sf_dir)
    vectors = lambda name, id_: materialised(encoder.encoded(lexical.split(table(spark, sf_dir, name).select(F.col(id_).alias("id"), "text")), terms))  # noqa: E731  read again and again
    docs, asked = vectors("documents", "doc_id"), vectors("benchmark", "item_id")
    return retrieval.nearest(asked.withColumnRenamed("id", "query"), docs.withColumnRenamed("id", "doc"), K).select("query", "doc", "score", "rank")


@query()
def dense_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By query of `dense_topk`, how many vectors it was multiplied with, and how many there are."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    rows = dense.searched(v.where("doc % 100 = 0").withColumnRenamed("doc", "query"), v, K).groupBy("query").agg(F.sum("multiplied").alias("multiplied"))
    return rows.join(F.broadcast(v.agg(F.count("vector").alias("vectors"))))


def pool_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A turn for each customer, about the product that its number stands for: (turns, products, postings)."""
    cards, items = part_cards(spark, sf_dir), catalog(spark, sf_dir)
    posted = cat.postings(cards, "doc", "constraints")
    turns = customer_targets(spark, sf_dir).join(cards, "doc").select("query", "bucket", F.slice("constraints", 1, 3).alias("constraints"), text.word_set(F.concat_ws(" ", F.slice("constraints", 1, 3))).alias("vocab"))
    turns = materialised(turns)  # read again and again
    products = items.select("doc", "bucket", text.word_set(F.concat_ws(" ", "title", "store", "bucket")).alias("tokens"), (0.05 * F.log1p(F.col("cnt").cast("double"))).alias("boost"), F.col("cnt").alias("count"), "price")
    return turns, products, posted


_POOL = f"""{CATALOG}, {CARDS}, p AS (SELECT doc, i - 1 AS position, constraints[i] AS phrase FROM cards, generate_series(1, 10) AS g(i) WHERE i <= len(constraints)), d AS (SELECT phrase, count(DISTINCT doc) AS df FROM p GROUP BY phrase),
turns AS (SELECT c_custkey AS query, bucket, list_slice(constraints, 1, 3) AS cs FROM customer JOIN cards ON doc = (c_custkey * 7) % (SELECT count(*) FROM part)),
q AS (SELECT query, i - 1 AS seen_at, cs[i] AS phrase FROM turns, generate_series(1, 3) AS g(i) WHERE i <= len(cs)),
m AS (SELECT query, doc, sum(20.0::DOUBLE / df) AS exact, sum(CASE WHEN position = seen_at THEN 0.5::DOUBLE ELSE 0 END) AS same, sum(abs(position - seen_at)) AS distance, count(*) AS matches FROM q JOIN d USING (phrase) JOIN p USING (phrase) GROUP BY query, doc),
v AS MATERIALIZED (SELECT query, bucket, list_distinct(regexp_extract_all(lower(array_to_string(cs, ' ')), '[a-z0-9]+')) AS vocab, TRY_CAST(nullif(regexp_extract(array_to_string(cs, '|'), '\\$\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS budget FROM turns),
s AS MATERIALIZED (SELECT v.query, c.doc, cnt, c.price, budget, coalesce(matches, 0) AS matches, round(coalesce(exact, 0) + coalesce(same, 0) - 0.05::DOUBLE * coalesce(distance, 0) + 0.05::DOUBLE * len(list_intersect(vocab, list_distinct(regexp_extract_all(lower(concat(title, ' ', store, ' ', c.bucket)), '[a-z0-9]+')))) + 0.05::DOUBLE * ln(1 + cnt), 6) AS base
  FROM v JOIN catalog c ON c.bucket = v.bucket LEFT JOIN m ON m.query = v.query AND m.doc = c.doc),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY base DESC, doc) AS first_rank FROM s QUALIFY first_rank <= 50),
pool AS MATERIALIZED (SELECT query, doc, base, first_rank, round(base + 2.5::DOUBLE * matches + 0.05::DOUBLE * ln(1 + cnt) + 0.3::DOUBLE * (CASE WHEN budget IS NOT NULL THEN greatest(0, 1 - abs(price - budget) / greatest(budget, 1)) ELSE 0 END), 6) AS score FROM f)"""


POOL = _POOL.replace("first_rank <= 50", f"first_rank <= {max(DEFAULT.rerank_k, DEFAULT.top_k)}")
WHOLE_POOL = _POOL.replace(" QUALIFY first_rank <= 50", "")


@query(f"WITH {POOL} SELECT query, doc, base, first_rank, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM pool QUALIFY rank <= {K}")
def fast_pool_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pool_ranks(*pool_turns(spark, sf_dir))


@query()
def pool_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By bucket: its questions, the products of their pools, and how many of these were scored for the first pass."""
    turns, products, posted = pool_turns(spark, sf_dir)
    asked, _ = pool.questions(turns, posted)
    asked = materialised(asked)
    rows = pool.reads(asked, products, posted, retrieval.FIRST_PASS, DEFAULT.rerank_k).join(asked.select("question", "bucket"), "question")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("questions"), F.sum("pool").alias("pool"), F.sum("read").alias("read"))


@query(f"""WITH {CATALOG}, o AS (SELECT p_type AS query, p_partkey AS doc, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 6),
pop AS (SELECT doc, row_number() OVER (ORDER BY cnt DESC, stars DESC, doc) AS pop_rank FROM catalog), r AS (SELECT query, doc, 0 AS tier, rank FROM o UNION ALL SELECT t.query, pop.doc, 1, pop_rank FROM (SELECT DISTINCT p_type AS query FROM part) t, pop WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query = t.query AND o.doc = pop.doc))
SELECT query, doc, tier, row_number() OVER (PARTITION BY query ORDER BY tier, rank, doc) AS place FROM r QUALIFY place <= {K}""")
def popularity_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("query"), F.col("p_partkey").alias("doc"), F.col("p_retailprice").alias("score"))
    return retrieval.backfilled(retrieval.best(p, 6, ["query"]), cat.popularity(catalog(spark, sf_dir), "doc", "cnt", "stars"), p.select("query").distinct(), K)


def two_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lexical_hits(spark, sf_dir, 50).select("query", F.lit("lexical").alias("route"), "doc", "score", "rank")
    return a.unionByName(phrase_hits(spark, sf_dir).select("query", F.lit("exact").alias("route"), "doc", "score", "rank"))


FUSED = f"""{BM25}, {EXACT}, routes AS (SELECT query, doc, 0.6::DOUBLE / (60 + rank) AS part FROM lexical_hits WHERE rank <= 50 UNION ALL SELECT query, doc, 1.0::DOUBLE / (60 + rank) FROM exact_hits WHERE rank <= 50),
fused0 AS (SELECT query, doc, count(*) AS n_routes, round(sum(part) * (1 + 0.1::DOUBLE * (count(*) - 1)), 9) AS score FROM routes GROUP BY query, doc), fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fused0 QUALIFY rank <= 50)"""


@query(f"WITH {FUSED} SELECT query, doc, n_routes, score, rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fused(two_routes(spark, sf_dir)).select("query", "doc", "n_routes", "score", "rank")


@query(f"WITH {FUSED} SELECT query, CASE WHEN max(score) FILTER (rank = 2) IS NULL THEN 1.0 ELSE round((max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / greatest(max(score) FILTER (rank = 1), 1e-9), 6) END AS margin FROM fused WHERE rank <= 2 GROUP BY query")
def rerank_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.margins(ranking.fused(two_routes(spark, sf_dir)))


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the pool ranking with their thirteen features."""
    turns, products, posted = pool_turns(spark, sf_dir)
    ranked = retrieval.pool_ranks(turns, products, posted)
    cards = part_cards(spark, sf_dir)
    items = catalog(spark, sf_dir)
    rows = ranked.join(turns.select("query", F.col("constraints").alias("asked"), F.col("bucket").alias("leaf"), "vocab").hint("merge"), "query").join(cards.select("doc", "constraints").hint("merge"), "doc").join(items.select("doc", "title", "bucket", "cnt", "price", "stars", "size"), "doc")
    made = ranking.features(
        F.col("score"), F.col("asked"), F.transform("asked", lambda _: F.lit(1.0)), F.lower("leaf"), F.array_sort("vocab"), F.when(F.col("query") % 3 == 0, "men").when(F.col("query") % 3 == 1, "women"),
        {"attrs": F.col("constraints"), "blob": F.lower(F.concat_ws(" ", "title", "bucket")), "leaf": F.col("bucket"), "path": F.array("bucket", "title"), "title_terms": F.split(F.lower("title"), " "), "count": F.col("cnt"), "sparse": F.col("size") < 10,
         "department": F.when(F.col("doc") % 4 == 0, "men").when(F.col("doc") % 4 == 1, "women").otherwise(""), "price": F.col("price"), "stars": F.col("stars")},
    )
    return rows.select("query", "doc", *[F.round(v, 6).alias(k) for k, v in made.items()])


FEATURES = f"""{POOL}, best AS MATERIALIZED (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM pool QUALIFY rank <= {K}),
r AS MATERIALIZED (SELECT b.query, b.doc, b.score AS fused, t.cs, lower(t.bucket) AS leaf, v.vocab, k.constraints AS attrs, lower(concat(c.title, ' ', c.bucket)) AS blob, c.bucket, c.title, c.cnt, c.price, c.stars, c.size,
  CASE b.query % 3 WHEN 0 THEN 'men' WHEN 1 THEN 'women' END AS gender, CASE b.doc % 4 WHEN 0 THEN 'men' WHEN 1 THEN 'women' ELSE '' END AS department FROM best b JOIN turns t USING (query) JOIN v USING (query) JOIN cards k ON k.doc = b.doc JOIN catalog c ON c.doc = b.doc),
h AS (SELECT *, len(list_filter(cs, lambda x: list_contains(attrs, x) OR contains(blob, x))) AS hits FROM r),
features AS (SELECT query, doc, round(fused, 6) AS fused, round(hits / greatest(len(cs), 1), 6) AS coverage, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN leaf <> '' AND lower(bucket) = leaf THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS leaf_exact,
  CAST(len(list_filter([bucket, title], lambda x: contains(lower(x), leaf) OR contains(leaf, lower(x)))) AS DOUBLE) AS path_overlap, round(len(list_intersect(vocab, list_distinct(string_split(lower(title), ' ')))) / greatest(len(vocab), 1), 6) AS title_overlap,
  round(ln(1 + cnt), 6) AS log_count, CASE WHEN size < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sparse, CASE WHEN gender = department THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gender_match, CASE WHEN gender IS NOT NULL AND department <> '' AND gender <> department THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gender_mismatch,
  CASE WHEN hits = 0 AND lower(bucket) <> leaf THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unmatched, CASE WHEN price IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_price, round(stars, 6) AS stars FROM h)"""


@query(f"WITH {FEATURES} SELECT * FROM features")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_features(spark, sf_dir)


@query(f"""WITH {FEATURES}, scored AS (SELECT query, doc, round(0.005::DOUBLE * log_count + fused + 2.0 * coverage + 0.6::DOUBLE * confidence + 0.8::DOUBLE * leaf_exact + 0.15::DOUBLE * path_overlap + 0.4::DOUBLE * title_overlap + 1.8::DOUBLE * gender_match - 0.15::DOUBLE * sparse - 1.5 * unmatched - 4.0 * gender_mismatch, 6) AS score FROM features)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored""")
def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_features(spark, sf_dir).withColumn("score", ranking.heuristic(F.lit(True)))
    return retrieval.best(rows, 1 << 30, ["query"]).select("query", "doc", "score", "rank")


_SCORES = " UNION ALL ".join(f"SELECT '{name}' AS variant, query, doc, round({' + '.join(f'{w!r}::DOUBLE * {c}' for c, w in parts.items())}, 9) AS score FROM evidence" for name, parts in retrieval.FORMULAS.items())


@query(f"""WITH {WHOLE_POOL}, pop AS (SELECT doc, row_number() OVER (ORDER BY cnt DESC, stars DESC, doc) AS pop_rank FROM catalog),
evidence AS MATERIALIZED (SELECT t.query, c.doc, coalesce(exact, 0) AS exact, coalesce(same, 0) * 2 AS same, coalesce(distance, 0) AS distance, coalesce(matches, 0) AS matches, len(list_intersect(vocab, list_distinct(regexp_extract_all(lower(concat(title, ' ', store, ' ', c.bucket)), '[a-z0-9]+')))) AS overlap,
  len(list_filter(cs, lambda x: contains(lower(concat(title, ' ', store, ' ', c.bucket)), lower(x)))) AS in_text, ln(1 + cnt) AS log_count, stars, pop_rank FROM turns t JOIN v USING (query) JOIN catalog c ON c.bucket = t.bucket JOIN pop ON pop.doc = c.doc LEFT JOIN m ON m.query = t.query AND m.doc = c.doc),
scored AS ({_SCORES}) SELECT variant, query, doc, score, row_number() OVER (PARTITION BY variant, query ORDER BY score DESC, doc) AS rank FROM scored QUALIFY rank <= {K}""")
def rank_formula_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten formulas, each over every turn's whole pool."""
    turns, products, posted = pool_turns(spark, sf_dir)
    items = catalog(spark, sf_dir)
    popular = cat.popularity(items, "doc", "cnt", "stars").select("doc", F.col("rank").alias("pop_rank"))
    said = items.select("doc", F.lower(F.concat_ws(" ", "title", "store", "bucket")).alias("search_text"), "stars").join(popular, "doc", "left")
    return retrieval.formula_ranks(turns, products.drop("boost", "price").join(said, "doc"), posted, K).select("variant", "query", "doc", "score", "rank")


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: two routes, fused, backfilled by length to ten."""
    found = ranking.fused(two_routes(spark, sf_dir), n=K)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("n"), F.lit(0.0).alias("stars"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    return retrieval.backfilled(found, cat.popularity(docs, "doc", "n", "stars"), asked, K)
