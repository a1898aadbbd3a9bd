"""Constraints of an utterance: phrases that the index knows, categories, genders, and the nearest phrases by meaning.

Utterances are rows (query, text) with the normalised text. Every branch is a join of what an utterance holds (its word runs
and their aliases) with a vocabulary, so nothing is looked up row by row; the branches are united and told once each.
Constraints are rows (query, phrase, attribute, source, confidence, pos), pos being the order of a query's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Config
from plumbline.functions import lexicon, text
from plumbline.operators import retrieval, sessions

#: Where each branch's constraints begin in the order.
CATEGORY_POS, GENDER_POS, SEMANTIC_POS = 1_000_000, 1_000_001, 1_000_002


def utterance(message: Column) -> Column:
    """The normalised text; the single word `shoe` means its plural."""
    n = text.normalise(message)
    return F.when(n == "shoe", "shoes").otherwise(n)


def _constraints(rows: DataFrame, source: str, confidence: Column, pos: Column, attribute: Column | None = None) -> DataFrame:
    attribute = lexicon.guess_attribute(F.col("phrase")) if attribute is None else attribute
    return rows.select("query", "phrase", attribute.alias("attribute"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"), pos.cast("bigint").alias("pos"))


def lexical(utterances: DataFrame, vocabulary: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Runs of 1 to ngram_max words, and aliases, that are in the vocabulary (phrase)."""
    windows = F.array_distinct(F.concat(text.ngrams(F.col("text"), 1, config.ngram_max), lexicon.expand_terms(F.col("text"))))
    rows = utterances.select("query", F.posexplode(windows).alias("pos", "phrase")).join(vocabulary.select("phrase").distinct(), "phrase", "left_semi")
    return _constraints(rows, "exact", F.lit(1.0), F.col("pos"))


def categories(utterances: DataFrame, phrases: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The longest category that an utterance holds as a run of words; else the longest among its aliases, with less
    confidence. Categories of ngram_max words at most; those that name a gender are none."""
    known = phrases.select("phrase").distinct().where(lexicon.canonical_gender(F.col("phrase")).isNull() & (F.col("phrase") != ""))
    none = F.array().cast("array<string>")
    held = F.transform(text.ngrams(F.col("text"), 1, config.ngram_max), lambda p: F.struct(p.alias("phrase"), F.lit(0).alias("tier")))
    meant = F.transform(F.when(F.col("text") == "", none).otherwise(lexicon.expand_terms(F.col("text"))), lambda p: F.struct(p.alias("phrase"), F.lit(1).alias("tier")))
    rows = utterances.select("query", F.explode(F.array_distinct(F.concat(held, meant))).alias("x")).select("query", "x.*")
    rows = rows.where((F.col("tier") == 1) | (F.length("phrase") >= config.least_category)).join(known, "phrase", "left_semi")
    first = rows.groupBy("query").agg(F.min(F.struct("tier", (-F.length("phrase")).alias("shorter"), "phrase")).alias("b")).select("query", "b.phrase", "b.tier")
    return _constraints(first, "category", F.when(F.col("tier") == 0, 1.0).otherwise(0.9), F.lit(CATEGORY_POS), F.lit("category"))


def genders(utterances: DataFrame) -> DataFrame:
    rows = utterances.select("query", lexicon.canonical_gender(F.col("text")).alias("phrase")).where("phrase is not null")
    return _constraints(rows, "exact", F.lit(1.0), F.lit(GENDER_POS), F.lit("department"))


def unknown_share(utterances: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query, n, unknown, ratio): how many of an utterance's words are no phrase of their own; 0 without words."""
    words = F.filter(F.split("text", " "), lambda t: t != "")
    rows = utterances.select("query", F.explode_outer(words).alias("phrase")).join(vocabulary.select("phrase", F.lit(True).alias("known")).distinct(), "phrase", "left")
    sums = rows.groupBy("query").agg(F.count("phrase").alias("n"), F.count_if(F.col("phrase").isNotNull() & F.col("known").isNull()).alias("unknown"))
    return sums.withColumn("ratio", F.when(F.col("n") > 0, F.col("unknown") / F.col("n")).otherwise(0.0))


def needs_meaning(found: DataFrame, shares: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query, ratio, needs): whether the nearest phrases are asked for: forced, too few exact constraints, or too many
    unknown words."""
    exact = found.where("source = 'exact'").groupBy("query").agg(F.count(F.lit(1)).alias("n_exact"))
    few = F.coalesce("n_exact", F.lit(0)) < config.semantic_fallback_threshold
    return shares.join(exact, "query", "left").select("query", "ratio", (F.lit(config.force_semantic) | few | (F.col("ratio") >= config.oov_token_ratio)).alias("needs"))


def nearest_phrases(vectors: DataFrame, phrases: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """vectors (query, vector) of utterances that need it, against phrases (doc, phrase, vector): the best few above a
    floor, with the cosine as confidence."""
    hits = retrieval.nearest(vectors, phrases, config.semantic_k).where(F.col("score") >= config.semantic_cosine_floor)
    rows = hits.join(phrases.select("doc", "phrase"), "doc")
    return _constraints(rows, "semantic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), F.col("rank") + SEMANTIC_POS)


def extracted(utterances: DataFrame, vocabulary: DataFrame, phrases: DataFrame, meaning: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """All constraints of each utterance, one for each phrase and source: (query, phrase, source, confidence, pos)."""
    parts = [lexical(utterances, vocabulary, config), categories(utterances, phrases, config), genders(utterances)]
    return sessions.merged(reduce(DataFrame.unionByName, parts + ([meaning] if meaning is not None else [])))
