"""Words that an index makes from texts are those of the regular expression, and texts are handed over whole."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import lexical

TEXTS = ["", None, "a", " a b", "a-b--c9 ", "x", "yz", "ñandú é1", "\n\t", "日本a日", "end", "0", "a\0b", "\U0001f600q"]


def test_words():
    want = [re.findall("[a-z0-9]+", t or "") for t in TEXTS]
    texts = pa.array(TEXTS, pa.string())
    assert lexical.words(texts).to_pylist() == want
    for a in range(len(TEXTS)):
        for n in (0, 1, 3, len(TEXTS)):
            assert lexical.words(texts.slice(a, n)).to_pylist() == want[a : a + n]


def test_an_index_of_texts_is_that_of_their_words(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if t is None else t.upper() * (i % 3 + 1)) for i, t in enumerate(TEXTS * 5)], "doc long, text string").coalesce(2)
    split = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("terms")
    seen = lambda index: sorted(map(repr, index.drop("cell").collect()))
    assert seen(lexical.indexed(rows, 2)) == seen(lexical.indexed(rows.select("doc", split), 2))
    assert "regexp_extract_all" not in lexical.indexed(rows)._jdf.queryExecution().toString()


def test_search_keeps_all_tasks(spark):
    index = lexical.indexed(spark.range(40).select(F.col("id").alias("doc"), F.array(F.lit("a"), (F.col("id") % 5).cast("string")).alias("terms")), cell_docs=2)
    asked = spark.createDataFrame([(1, "a", 1.0), (2, "3", 1.0)], "query long, term string, weight double")
    assert lexical.search(index, asked, 3).rdd.getNumPartitions() == 4
