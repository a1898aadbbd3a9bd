"""Counters that come with a result: observed while it is written, not counted by a second query.

A result is written once, to a folder that all executors share, and is read from there. Its counters are sums over the rows of
the last stage, whose tasks count once each, however often one is run again or executors are lost; so they are no part of
a plan that may be computed twice.

Defined cases: a counter whose condition is null for a row doesn't count it; no rows give zeros.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import shared_folder

COUNTERS = "counter string, n long"


def written(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """df, written and read again, and for each name how many of its rows meet the condition."""
    if not conditions:
        raise ValueError("no counter is named")
    at = f"{shared_folder(df.sparkSession)}/counted-{uuid.uuid4().hex}"
    seen = Observation()
    count = lambda met: F.coalesce(F.sum(F.coalesce(met, F.lit(False)).cast("long")), F.lit(0))
    df.observe(seen, *[count(met).alias(name) for name, met in conditions.items()]).write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), {name: int(seen.get[name]) for name in conditions}


def asks(ask: Column, attributes: tuple[str, ...]) -> dict[str, Column]:
    """A counter for each attribute that may be asked for, and one for turns without a question."""
    return {"ask_" + a: ask == a for a in attributes} | {"ask_none": ask.isNull()}


def reported(spark: SparkSession, *counts: dict[str, int]) -> DataFrame:
    """(counter, n) of some results' counters; those of one name are added."""
    total: dict[str, int] = {}
    for each in counts:
        for name, n in each.items():
            total[name] = total.get(name, 0) + n
    return spark.createDataFrame(sorted(total.items()), COUNTERS)
