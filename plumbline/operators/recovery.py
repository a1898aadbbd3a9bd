"""Recovery of queries that find too little, stage by stage.

A query whose fused hits are fewer than k loses its weakest constraint and asks again, up to `drops` times or until it has none;
the last hits stand, however few. What is still missing is appended from a route that needs no constraints, in that route's order,
and is not ranked anew. Each stage is given only the queries that are still short (by a semi-join with the stage before, which
is kept in the shared folder), so a query that is settled is read by no later route, and stages end with the last open query.

Defined cases: a query without constraints goes to the last route at once. Equal confidences: the smaller phrase is weaker; a null
confidence is the weakest. Hits of the last route that a query has already are passed over. Repeated queries count once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT
from plumbline.sources.tables import materialised

CONSTRAINTS, LEXICAL = "constraints", "lexical"


def staged(queries: DataFrame, constraints: DataFrame, fused: Callable[[DataFrame], DataFrame], last: Callable[[DataFrame], DataFrame], k: int = DEFAULT.top_k, drops: int = 3) -> DataFrame:
    """(query, doc, tier, level, place) of queries (query) with constraints (query, phrase, confidence). fused: from constraints
    to (query, doc, rank); last: from queries to (query, doc, rank). level: how many constraints a query has lost."""
    weak = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_first("confidence"), "phrase"))
    told = materialised(constraints.join(queries.select("query").distinct(), "query", "left_semi").withColumn("weak", weak))
    n = told.groupBy("query").agg(F.count(F.lit(1)).alias("told"))
    open_ = materialised(queries.select("query").distinct().join(n, "query", "left").select("query", F.least(F.coalesce("told", F.lit(0)), F.lit(drops)).alias("may")))
    kept, short = [], []
    for level in range(drops + 1):
        asks = told.where(F.col("weak") > level).join(open_.select("query"), "query", "left_semi").drop("weak")
        hits = materialised(fused(asks).select("query", "doc", "rank"))
        known = open_.join(hits.groupBy("query").agg(F.count(F.lit(1)).alias("found")), "query", "left").withColumn("found", F.coalesce("found", F.lit(0)))
        known = materialised(known.withColumn("ends", (F.col("found") >= k) | (F.col("may") <= level)))
        ended = known.where("ends").select("query", "found", F.lit(level).alias("level"))
        kept.append(hits.join(ended, "query").select("query", "doc", F.lit(CONSTRAINTS).alias("tier"), "level", F.col("rank").cast("long").alias("place")))
        short.append(ended.where(F.col("found") < k))
        open_ = known.where(~F.col("ends")).select("query", "may")
        if open_.isEmpty():
            break
    own, missing = reduce(DataFrame.unionByName, kept), materialised(reduce(DataFrame.unionByName, short))
    if missing.isEmpty():
        return own
    more = last(missing.select("query")).select("query", "doc", "rank").join(own.select("query", "doc"), ["query", "doc"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("rank", "doc"))
    more = more.withColumn("nth", nth).where(F.col("nth") <= k).join(missing, "query").withColumn("place", (F.col("found") + F.col("nth")).cast("long")).where(F.col("place") <= k)
    return own.unionByName(more.select("query", "doc", F.lit(LEXICAL).alias("tier"), "level", "place"))
