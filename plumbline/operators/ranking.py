"""Rank fusion, margins, features and linear reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Config
from plumbline.operators.retrieval import best

#: Coefficients of the heuristic score, in order. Fixed values.
HEURISTIC = (("fused", 1.0), ("coverage", 2.0), ("confidence", 0.6), ("leaf_exact", 0.8), ("path_overlap", 0.15), ("title_overlap", 0.4), ("gender_match", 1.8), ("sparse", -0.15), ("unmatched", -1.5), ("gender_mismatch", -4.0))
POPULARITY_WITH, POPULARITY_WITHOUT = 0.005, 0.04


def fused(hits: DataFrame, config: Config = DEFAULT, n: int | None = None) -> DataFrame:
    """hits (query, route, doc, score, rank): weighted reciprocal ranks over the routes that have the document, raised with
    the number of routes; a route whose best score is below its floor is left out."""
    weight = F.lit(None).cast("double")
    for route, w in config.weights.items():
        weight = F.when(F.col("route") == route, F.lit(w)).otherwise(weight)
    rows = hits
    if config.floors:
        floor = F.coalesce(*[F.when(F.col("route") == r, F.lit(float(v))) for r, v in config.floors.items()], F.lit(0.0))
        rows = rows.withColumn("_top", F.max("score").over(Window.partitionBy("query", "route"))).where(F.col("_top") >= floor).drop("_top")
    part = F.coalesce(weight, F.lit(1.0)) / (F.lit(config.rrf_k) + F.col("rank"))
    sums = rows.groupBy("query", "doc").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("n_routes"))
    return best(sums.withColumn("score", F.round(F.col("s") * (1 + config.agreement * (F.col("n_routes") - 1)), 9)).drop("s"), n or config.n_fuse, ["query"])


def margins(ranked: DataFrame) -> DataFrame:
    """(query, n, margin): how far the first is ahead of the second, relative to its score; 1 if there is no second."""
    top = ranked.where("rank <= 2").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s0"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s1"))
    return top.select("query", F.when(F.col("s1").isNull(), 1.0).otherwise(F.round((F.col("s0") - F.col("s1")) / F.greatest("s0", F.lit(1e-9)), 6)).alias("margin"))


def features(fused_score: Column, phrases: Column, confidences: Column, leaf: Column, terms: Column, gender: Column, product: dict[str, Column]) -> dict[str, Column]:
    """The thirteen features of a candidate, by name. product: attrs, blob, leaf, path, title_terms, count, sparse,
    department, price, stars."""
    hit = lambda p: F.array_contains(product["attrs"], p) | product["blob"].contains(p)
    found = F.filter(F.zip_with(phrases, confidences, lambda p, c: F.when(hit(p), F.coalesce(c, F.lit(1.0)))), lambda c: c.isNotNull())
    n = F.size(phrases)
    coverage = F.size(found) / F.greatest(n, F.lit(1))
    confidence = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, c: a + c) / F.size(found)).otherwise(0.0)
    leaf_exact = F.when((leaf != "") & (F.lower(product["leaf"]) == leaf), 1.0).otherwise(0.0)
    path = F.when(leaf == "", 0.0).otherwise(F.size(F.filter(product["path"], lambda c: F.lower(c).contains(leaf) | leaf.contains(F.lower(c)))).cast("double"))
    title = F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, product["title_terms"])) / F.size(terms)).otherwise(0.0)
    match = F.when(gender == product["department"], 1.0).otherwise(0.0)
    mismatch = F.when(gender.isNotNull() & (product["department"] != "") & (gender != product["department"]), 1.0).otherwise(0.0)
    unmatched = F.when(((n > 0) | (leaf != "")) & (coverage == 0) & (leaf_exact == 0), 1.0).otherwise(0.0)
    return {
        "fused": fused_score, "coverage": coverage, "confidence": confidence, "leaf_exact": leaf_exact, "path_overlap": path, "title_overlap": title, "log_count": F.log1p(product["count"].cast("double")), "sparse": product["sparse"].cast("double"),
        "gender_match": match, "gender_mismatch": mismatch, "unmatched": unmatched, "has_price": product["price"].isNotNull().cast("double"), "stars": product["stars"],
    }


def heuristic(has_constraints: Column) -> Column:
    """The linear score of the feature columns."""
    out = F.when(has_constraints, POPULARITY_WITH).otherwise(POPULARITY_WITHOUT) * F.col("log_count")
    for name, w in HEURISTIC:
        out = out + w * F.col(name)
    return F.round(out, 6)


def reranked(rows: DataFrame, margin: DataFrame, mode: str = "heuristic", config: Config = DEFAULT) -> DataFrame:
    """rows (query, doc, score, rank, rescored): the new order, unless the mode is off, or is cascade and the margin is
    high; a learnt mode without a model falls back to the heuristic."""
    keep = F.lit(mode == "off") | (F.lit(mode == "cascade") & (F.col("margin") > config.margin_high))
    rows = rows.join(margin, "query").withColumn("final", F.when(keep, F.col("score")).otherwise(F.col("rescored")))
    return best(rows, 1 << 30, ["query"], "final", name="final_rank").select("query", "doc", "final", "final_rank")
