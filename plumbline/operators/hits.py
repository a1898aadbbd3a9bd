"""Hits: long tables (query, doc, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(hits: DataFrame, k: int, query: list[str], score: str = "score", doc: str = "doc", name: str = "rank") -> DataFrame:
    """The k best documents of each query, numbered."""
    w = Window.partitionBy(*query).orderBy(F.desc(score), F.asc(doc))
    return hits.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))
