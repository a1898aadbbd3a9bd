"""Per-session state as ordered folds over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT, Config
from plumbline.functions import lexicon

STATE = "struct<bucket:string,constraints:array<string>,opening:array<string>,vocab:array<string>,asked:int>"


def empty_state() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(None).cast("string").alias("bucket"), none.alias("constraints"), none.alias("opening"), none.alias("vocab"), F.lit(0).alias("asked")).cast(STATE)


def advance(s: Column, words: Column, e: Column) -> Column:
    """The state after a turn with these words and this event. Only a first opening sets the bucket; an override drops what
    the opening asked for and starts the words and the questions anew; constraints are kept once each, in order."""
    none = F.array().cast("array<string>")
    opens = (e["kind"] == "opening") & e["category"].isNotNull() & s["bucket"].isNull()
    over = e["kind"] == "override"
    kept = F.when(over, F.array_except(s["constraints"], s["opening"])).otherwise(s["constraints"])
    return F.struct(
        F.when(opens, e["category"]).otherwise(s["bucket"]).alias("bucket"), F.array_union(kept, e["constraints"]).alias("constraints"),
        F.when(over, none).when(opens & (e["scenario_hint"] == "intent_override"), e["constraints"]).otherwise(s["opening"]).alias("opening"),
        F.when(over, F.array_distinct(words)).otherwise(F.array_union(s["vocab"], words)).alias("vocab"), (F.when(over, 0).otherwise(s["asked"]) + 1).cast("int").alias("asked"),
    ).cast(STATE)


def folded(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """turns (session, turn, words, event): the state after each turn. Turns beyond max_turns are no part of a session, so
    its turns are one small array; the fold is one JVM aggregate over it that keeps the states it passes."""
    listed = turns.where(F.col("turn") <= config.max_turns).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "words", "event"))).alias("ts"))
    states = F.aggregate("ts", F.array(empty_state()), lambda a, t: F.concat(a, F.array(advance(F.element_at(a, -1), t["words"], t["event"]))))
    each = listed.select("session", F.explode(F.arrays_zip(F.col("ts.turn").alias("turn"), F.slice(states, 2, F.greatest(F.size("ts"), F.lit(1))).alias("state"))).alias("x"))
    return each.select("session", "x.turn", "x.state")


def emits(n_constraints: Column, turn: Column, config: Config = DEFAULT) -> Column:
    """Whether a turn's slate is shown: two constraints, the last turn, or one constraint from the fourth turn on."""
    return (n_constraints >= 2) | (turn >= config.max_turns) | ((n_constraints >= 1) & (turn >= 4))


def running_distinct(tokens: DataFrame) -> DataFrame:
    """tokens (session, turn, token): (session, turn, n) distinct tokens up to each turn, by each token's first turn."""
    first = tokens.groupBy("session", "token").agg(F.min("turn").alias("turn")).groupBy("session", "turn").agg(F.count(F.lit(1)).alias("new"))
    turns = tokens.select("session", "turn").distinct().join(first, ["session", "turn"], "left")
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("session", "turn", F.sum(F.coalesce("new", F.lit(0))).over(w).alias("n"))


def slots(changes: DataFrame) -> DataFrame:
    """changes (session, slot, value, at): the newest value of each slot, and the distinct values it superseded."""
    return changes.groupBy("session", "slot").agg(F.max(F.struct("at", "value")).alias("m"), F.collect_set("value").alias("all")).select("session", "slot", F.col("m.value").alias("value"), F.col("m.at").alias("set_at"), F.array_sort(F.array_except("all", F.array("m.value"))).alias("superseded"))


def decayed(confidence: Column, age: Column, superseded: Column, config: Config = DEFAULT) -> Column:
    return confidence * F.pow(F.lit(config.decay), F.greatest(age, F.lit(0))) * F.when(superseded, config.superseded).otherwise(1.0)


def repaired(fragments: DataFrame, posted: DataFrame, n_docs: Column) -> DataFrame:
    """fragments (query, parts): parts that a split on "; " has torn are joined again into one or two groups, by what the
    index holds; the raw parts stay if no grouping is known or there are two at most."""
    df = posted.groupBy("phrase").agg(F.count("doc").alias("df"))
    size = F.size("parts")
    rows = fragments.withColumn("cut", F.explode(F.when(size > 2, F.sequence(F.lit(0), size - 1)).otherwise(F.array(F.lit(-1)))))
    join = lambda a: F.array_join(a, "; ")
    groups = F.when(F.col("cut") == 0, F.array(join(F.col("parts")))).when(F.col("cut") > 0, F.array(join(F.slice("parts", 1, F.col("cut"))), join(F.slice("parts", F.col("cut") + 1, size)))).otherwise(F.col("parts"))
    rows = rows.withColumn("groups", groups)
    each = rows.where("cut >= 0").select("query", "cut", F.explode("groups").alias("phrase")).join(df, "phrase", "left")
    scores = each.groupBy("query", "cut").agg(F.sum(F.when(F.col("df") > 0, 1000 + F.log((n_docs + 1.0) / (F.col("df") + 1.0))).otherwise(-1.0)).alias("score"))
    rows = rows.join(scores, ["query", "cut"], "left")
    best = rows.groupBy("query").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.size("groups")).alias("fewer"), (-F.col("cut")).alias("first"), "groups")).alias("b"), F.first("parts").alias("parts"))
    return best.select("query", F.when(F.col("b.score") > 0, F.col("b.groups")).otherwise(F.col("parts")).alias("constraints"))


def category_slots(changes: DataFrame) -> DataFrame:
    """changes (session, at, attribute, value, confidence), attribute `category` for categories: the slots at the end.

    A new category clears all slots; a new value supersedes the old one; the same value again keeps the greater confidence.
    Gives (session, category, attribute, value, confidence, set_at, superseded)."""
    by = Window.partitionBy("session").orderBy("at")
    # the category before, in the order that the sums need too: no sort of its own
    before = F.last(F.when(F.col("attribute") == "category", F.struct("value")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))["value"]
    rows = changes.withColumn("cleared", ((F.col("attribute") == "category") & before.isNotNull() & (before != F.col("value"))).cast("int"))
    rows = rows.withColumn("part", F.sum("cleared").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("last_part", F.max("part").over(Window.partitionBy("session")))
    category = rows.where("attribute = 'category'").groupBy("session").agg(F.max_by("value", "at").alias("category"))
    slot = Window.partitionBy("session", "attribute").orderBy("at")
    rows = rows.where("attribute <> 'category' and part = last_part").withColumn("old", F.lag("value").over(slot))
    rows = rows.withColumn("new", F.when(F.col("old").isNull() | (F.col("old") != F.col("value")), 1).otherwise(0)).withColumn("run", F.sum("new").over(slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("last_run", F.max("run").over(Window.partitionBy("session", "attribute")))
    got = rows.groupBy("session", "attribute").agg(
        F.max_by("value", "at").alias("value"), F.max(F.when(F.col("run") == F.col("last_run"), F.col("confidence"))).alias("confidence"), F.max("at").alias("set_at"),
        F.array_sort(F.collect_set(F.when(F.col("old") != F.col("value"), F.col("old")))).alias("superseded"),
    )
    return got.join(category, "session", "left").select("session", "category", "attribute", "value", "confidence", "set_at", "superseded")


def active(slots_: DataFrame, turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Slots (session, category, attribute, value, confidence, set_at, superseded) as weighted constraints at each session's turn
    (turns: session, turn): values, what they superseded, and the category, which doesn't fade."""
    rows = slots_.join(turns, "session").withColumn("weight", decayed(F.col("confidence"), F.col("turn") - F.col("set_at"), F.lit(False), config))
    told = F.concat(F.array(F.struct("value", "weight")), F.transform("superseded", lambda v: F.struct(v.alias("value"), (F.col("weight") * config.superseded).alias("weight"))))
    values = rows.select("session", "attribute", F.explode(told).alias("x")).select("session", "attribute", F.col("x.value").alias("phrase"), F.round("x.weight", 6).alias("confidence"))
    if "category" not in slots_.columns:
        return values
    wanted = rows.where("category is not null and category <> ''").select("session", F.lit("category").alias("attribute"), F.col("category").alias("phrase"), F.lit(1.0).alias("confidence")).distinct()
    return values.unionByName(wanted)


def follow_up(normalised: Column, last_asked: Column) -> Column:
    """What a short answer fills: (attribute, value, confidence), or null. Up to two tokens if they name an attribute, up
    to four if a question was asked."""
    n = F.when(normalised == "", 0).otherwise(F.size(F.split(normalised, " ")))
    guess = lexicon.guess_attribute(normalised)
    attribute = F.when((n > 0) & (n <= 2) & guess.isNotNull(), guess).when((n > 0) & (n <= 4) & last_asked.isNotNull(), F.coalesce(guess, last_asked))
    value = F.when(attribute.isin("style", "department"), F.coalesce(lexicon.canonical_gender(normalised), normalised)).otherwise(normalised)
    return F.when(attribute.isNotNull() & ~attribute.isin("other", "category"), F.struct(attribute.alias("attribute"), value.alias("value"), F.when(guess.isNotNull(), 0.95).otherwise(0.8).alias("confidence")))


def merged(constraints: DataFrame) -> DataFrame:
    """constraints (query, phrase, source, confidence, pos): one for each phrase and source, the greatest confidence, in
    order of first appearance."""
    return constraints.groupBy("query", "phrase", "source").agg(F.max("confidence").alias("confidence"), F.min("pos").alias("pos"))
