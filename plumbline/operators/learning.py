"""A learnt reranker: rows, a stable split, and a pointwise model by Spark ML, beside the listwise one of `listwise`."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.catalog import ranked
from plumbline.operators.retrieval import best

NAMES = ("fused", "coverage", "confidence", "leaf_exact", "path_overlap", "title_overlap", "log_count", "sparse", "gender_match", "gender_mismatch", "unmatched", "has_price", "stars")
#: At most so many rows are fitted on, the smallest by a hash of query and document.
MAX_ROWS = 50_000


def split(samples: DataFrame, ratio: float = 0.8) -> DataFrame:
    """samples (id) with `train`: the first share of the ordered ids, at least one and not all."""
    rows = ranked(samples.select("id").distinct(), [F.asc("id")], "nth")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    cut = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.round(F.col("n") * ratio)))
    return rows.join(F.broadcast(n)).select("id", (F.col("nth") <= cut).alias("train"))


def fitted(rows: DataFrame, trees: int = 20, depth: int = 4, step: float = 0.1, max_rows: int = MAX_ROWS) -> PipelineModel:
    """rows (query, doc, label and the features)."""
    some = rows.orderBy(F.xxhash64("query", "doc"), "query", "doc").limit(max_rows)
    vector = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    tree = GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, seed=1).fit(vector.transform(some).select("label", "features"))
    return PipelineModel([vector, tree])


#: In place of a model: the rows have their prediction.
PREDICTED = "predicted"


def rescored(rows: DataFrame, model: PipelineModel | str | None) -> DataFrame:
    """The order by the model's prediction; without a model, by the score that is there."""
    if model is None:
        scored = rows.withColumn("final", F.col("fused"))
    else:
        scored = (rows if model == PREDICTED else model.transform(rows)).withColumn("final", F.round("prediction", 6))
    return best(scored, 1 << 30, ["query"], "final", name="final_rank").select("query", "doc", "final", "final_rank")
