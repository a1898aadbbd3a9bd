"""The operators' queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_codec, chat, mcd_rules, negatives, ngram_trie, packing, sharding, simhash_gray, sketch, spelling, suffix_dedup, token_automaton, url_trees
from plumbline.llm.common import spread, table

MULTI_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.scored(spread(table(spark, sf_dir, "documents")))


def op2_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_likeness(spread(table(spark, sf_dir, "documents")))


def op3_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_rules.judged(spread(table(spark, sf_dir, "documents")))


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.components(spread(table(spark, sf_dir, "documents")))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encoded(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_automaton.counted(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(WORD_BPE))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spread(table(spark, sf_dir, "documents")), tokenizer=public_tokenizers.path(WORD_BPE))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(spread(table(spark, sf_dir, "documents")))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judged(table(spark, sf_dir, "pages"))


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spread(table(spark, sf_dir, "documents")))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(negatives.digest_rows(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_trie, op2_sketch, op3_mcd_rules, op4_simhash_gray, op5_bpe_codec, op6_perspectives, op7_token_automaton, op8_packing, op9_suffix_dedup, op10_url_trees, op11_rendezvous, op12_spelling, op13_negatives)}
ORACLE: dict[str, str] = {"op6_perspectives": chat.ORACLE, "op11_rendezvous": sharding.ORACLE, "op12_spelling": spelling.ORACLE, "op13_negatives": negatives.ORACLE}
