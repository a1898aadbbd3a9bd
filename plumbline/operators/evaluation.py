"""Slates, simulated customers and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Config
from plumbline.functions import lexicon
from plumbline.sources.tables import materialised

EXPLORING = "I'm looking for {}, but I'm still exploring."
REBUKE = "Those options are not quite right yet. Ask me about one specific attribute."


#: Rows of one id that meet the known ids in one task, about.
TOGETHER = 1 << 18


def spread_ids(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (query, id) and known (id) with a `piece`: rows of an id of which there are very many are dealt over several."""
    many = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER)  # of rows / TOGETHER ids at most
    many = materialised(many.select("id", F.ceil(F.col("n") / TOGETHER).cast("int").alias("pieces")))
    dealt = rows.join(F.broadcast(many), "id", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("query"), "pieces").cast("int"), F.lit(0))).drop("pieces")
    each = known.join(F.broadcast(many), "id", "left").select("id", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    return dealt, each


def slates(items: DataFrame, known: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """items (query, pos, id): trimmed, known ids only, the first of repeated ones, at most k, numbered."""
    rows, each = spread_ids(items.select("query", "pos", F.trim("id").alias("id")).where("id <> ''"), known.select("id").distinct())
    rows = rows.join(each, ["id", "piece"], "left_semi")
    first = rows.groupBy("query", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query").orderBy("pos")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", F.col("rank").cast("bigint").alias("rank"))


def metrics(sessions: DataFrame, scope: str = "scenario", config: Config = DEFAULT) -> DataFrame:
    """sessions (scope, hit, reciprocal_rank, first_hit_turn): per scope and, with a null scope, over all."""
    rows = sessions.groupingSets([[F.col(scope)], []], F.col(scope)).agg(
        F.count(F.lit(1)).alias("sample_count"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(F.coalesce("first_hit_turn", F.lit(config.miss_turn))), 6).alias("mttc"),
    )
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (config.miss_turn - F.col("mttc")) / config.max_turns))
    a, b, c = config.score_weights
    return rows.withColumn("efficiency", F.round(efficiency, 6)).withColumn("technical_score", F.round(a * F.col("hit_rate") + b * F.col("mrr") + c * F.col("efficiency"), 6))


def compared(current: DataFrame, previous: DataFrame, scope: str, measures: list[str]) -> DataFrame:
    """current and previous metrics side by side, with their differences."""
    p = previous.select(F.col(scope).alias("_s"), *[F.col(m).alias(f"previous_{m}") for m in measures])
    rows = current.join(p, current[scope].eqNullSafe(F.col("_s")), "left")
    return rows.select(scope, *measures, *[f"previous_{m}" for m in measures], *[F.round(F.col(m) - F.col(f"previous_{m}"), 6).alias(f"delta_{m}") for m in measures])


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "miss").when(rank == 1, "1").when(rank == 2, "2").when(rank == 3, "3").when(rank <= 10, "4-10").when(rank <= 50, "11-50").otherwise("51+")


def breakdown(sessions: DataFrame, by: list[str]) -> DataFrame:
    """sessions (hit, best_rank, pool_rank, and the columns `by`): for each value of each of `by`, and over all, how hits and
    misses are ranked, in one pass. pool_rank: the best place before the cut, null where the target was never in the pool."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    hit = F.coalesce(F.col("hit"), F.lit(False))
    sets = [[F.col(c)] for c in by] + [[]]
    rows = sessions.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.grouping_id(*by).cast("int").alias("_level"), F.count(F.lit(1)).alias("sessions"), n(hit & (F.col("best_rank") == 1), "rank_1"), n(hit & F.col("best_rank").isin(2, 3), "rank_2_3"), n(hit & F.col("best_rank").between(4, 10), "rank_4_10"),
        n(~hit, "misses"), n(~hit & F.col("pool_rank").isNotNull(), "misses_in_pool"), n(~hit & F.col("pool_rank").isNull(), "misses_not_in_pool"), n(hit & (F.col("best_rank") != 1), "hits_not_rank_1"),
        F.round(F.coalesce(F.sum(F.when(hit, F.col("best_rank"))), F.lit(0)) / F.greatest(F.count_if(hit), F.lit(1)), 4).alias("mean_rank_of_hits"),
    )
    # a set's own column is the one whose bit isn't raised
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        mine = F.col("_level") == (1 << len(by)) - 1 - (1 << (len(by) - 1 - i))
        name, value = F.when(mine, c).otherwise(name), F.when(mine, F.col(c).cast("string")).otherwise(value)
    return rows.select(name.alias("scope"), value.alias("value"), *rows.columns[len(by) + 1 :])


def worst(sessions: DataFrame, scope: str, n: int, id_: str) -> DataFrame:
    """The n worst sessions of each scope: misses before hits, targets that were never in the pool first, then by the places of
    pool and slate, the lowest first, then by id."""
    order = Window.partitionBy(scope).orderBy("hit", F.desc_nulls_first("pool_rank"), F.desc_nulls_first("best_rank"), id_)
    return sessions.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select(scope, "nth", id_, "hit", "pool_rank", "best_rank")


def richness(rows: DataFrame, of: Column, sparse_below: int, share: float = 0.1) -> DataFrame:
    """One row: how many records, how many are sparse, and the richness that a share of the records has at most (the value at
    place floor(share x n), 1 at least). Equal values are counted before they are ordered."""
    counts = rows.select(of.cast("long").alias("richness")).groupBy("richness").agg(F.count(F.lit(1)).alias("c"))
    # distinct values alone meet in one window
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("richness").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    at = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    return upto.join(F.broadcast(n)).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("richness") < sparse_below, F.col("c"))), F.lit(0)).alias("sparse"), F.coalesce(F.min(F.when(F.col("upto") >= at, F.col("richness"))), F.lit(0)).alias("p10"))


def ordered_variants(rows: DataFrame, variant: str, measure: str) -> DataFrame:
    """Variants from the best down, each with what it lacks of the best; a variant is a row."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(measure), variant)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).withColumn("behind", F.round(F.first(measure).over(w) - F.col(measure), 6)).select("place", variant, measure, "behind")


def opening(scenario: Column, category: Column, first_hard: Column, old_value: Column) -> Column:
    lead = F.concat(F.lit("I'm looking for "), category)
    return F.when((scenario == "buying") & first_hard.isNotNull(), F.concat(lead, F.lit(". A key requirement is: "), first_hard, F.lit("."))).when(scenario == "intent_override", F.concat(lead, F.lit(". "), old_value)).otherwise(F.concat(lead, F.lit(", but I'm still exploring.")))


def disclosed_next(constraints: Column, told: Column, attribute: Column) -> Column:
    """The next two constraints that answer for an attribute and have not been told."""
    return F.slice(F.filter(constraints, lambda c: ~F.array_contains(told, c) & ((attribute == "other") | (lexicon.classify_constraint(c) == attribute))), 1, 2)


def reply(next_: Column, attribute: Column, boundary: Column) -> Column:
    return F.when(boundary & attribute.isNotNull(), F.concat(F.lit("I don't have a preference for "), attribute, F.lit("; please use your judgment."))).when(attribute.isNull(), REBUKE).when(F.size(next_) == 0, F.concat(F.lit("I don't have an additional preference for "), attribute, F.lit("."))).otherwise(F.concat(F.lit("For that, what matters is: "), F.array_join(next_, "; "), F.lit(".")))


def nearest_rank(values: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, n, p...): the values at the nearest ranks, exact. Equal values are counted before they are ordered, so a
    group meets in a window with its distinct values only."""
    counts = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda q: F.least(F.greatest(F.ceil(F.col("n") * q), F.lit(1)), F.col("n"))
    return rows.groupBy(group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= at(q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares])


def usage(responses: DataFrame) -> DataFrame:
    """responses (prompt_tokens, completion_tokens): totals of the counts that are there and not negative."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).alias(c)
    return responses.agg(total("prompt_tokens"), total("completion_tokens")).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def ids_of(recommendations: Column) -> Column:
    """The trimmed ids of an array of structs with `parent_asin`."""
    return F.filter(F.transform(recommendations, lambda r: F.trim(r["parent_asin"])), lambda x: x != "")


def payload(message: Column, ask: Column, ids: Column) -> Column:
    zero = F.lit(0).alias
    return F.struct(message.alias("message"), ask.alias("ask_attribute"), F.transform(ids, lambda i: F.struct(i.alias("parent_asin"))).alias("recommendations"), F.struct(zero("prompt_tokens"), zero("completion_tokens")).alias("usage"))


def sampled(samples: DataFrame, seed: int, n: int) -> DataFrame:
    """n samples in an order that a seed shuffles, the same on every run."""
    return samples.orderBy(F.xxhash64(F.lit(seed), *samples.columns), *samples.columns).limit(n)


def accepted(metric: DataFrame, threshold: float = 0.80) -> DataFrame:
    return metric.where("scenario is null").select("technical_score", (F.col("technical_score") >= threshold).alias("accepted"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs gave the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
