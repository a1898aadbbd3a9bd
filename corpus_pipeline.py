"""From raw documents to packed training sequences.

Quality rules drop documents, SimHash near-deduplication keeps one of each group, repeated byte strings are cut out of the
texts, and what is left is packed into sequences. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases, as the operators' modules state them: null and empty texts go with the first stage, as do all of fewer than
50 words; of rows equal in id and text one stays; a text that is cut away as a whole stays as an empty one and is packed as
its end; very long texts are judged, compared and cut as any other; an empty table gives an empty result at each stage. Columns
beyond those of documents are carried through the first three stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mcd_rules, packing, simhash_gray, suffix_dedup
from plumbline.llm.common import checkpoint_dir, prepare, table
from plumbline.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mcd_rules.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_gray.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.packed(docs, tokenizer=public_tokenizers.path(WORD_BPE))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", repeated_strings), ("best-fit packing", best_fit_packing)]

#: SQL can't express the stages' methods (iterated estimates, fingerprints, components, byte strings, packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; what lies between them is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
