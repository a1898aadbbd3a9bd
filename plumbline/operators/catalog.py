"""Catalog records and the tables that are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULT
from plumbline.functions import lexicon, text

#: Materials and colours that an intent card names. Fixed values.
CARD_MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
CARD_COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first by `order`. Only (key, order) pairs are aggregated; the row follows as a struct."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.min_by(F.struct(order, *rest), order).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in (order, *rest)])


def products(records: DataFrame, sparse_below: int = DEFAULT.sparse_below) -> DataFrame:
    """Raw records (all columns text) to normalised products. Records without an id are dropped."""
    r = records.withColumns({
        "parent_asin": F.trim(F.coalesce(F.nullif("parent_asin", F.lit("")), F.col("asin") if "asin" in records.columns else F.lit(None))),
        "title": F.trim(F.coalesce("title", F.lit(""))), "features": text.string_list(F.col("features")), "description": text.description(F.col("description")),
        "category_path": text.string_list(F.col("categories")), "details": text.details(F.col("details")), "price": text.price(F.col("price")),
        "avg_rating": text.rating(F.col("average_rating")), "rating_count": text.rating_count(F.col("rating_number")), "store": F.trim(F.coalesce("store", F.lit(""))),
    }).where(F.col("parent_asin").isNotNull() & (F.col("parent_asin") != ""))
    r = r.withColumns({
        "leaf_category": F.coalesce(F.get("category_path", F.size("category_path") - 1), F.lit("")), "is_sparse": F.size("features") + F.when(F.col("description") != "", 1).otherwise(0) < sparse_below,
        "department": lexicon.department(F.col("category_path"), F.col("details"), F.col("title")), "title_n": text.normalise(F.col("title")), "store_n": text.normalise(F.col("store")),
        "short_features": F.transform(F.filter("features", lambda f: F.size(lexicon.tokens(f)) <= text.SHORT_FEATURE_TOKENS), lambda f: text.normalise(F.substring(f, 1, text.FEATURE_CHARS))),
        "category_n": F.transform("category_path", lambda c: text.normalise(c)),
        "detail_n": F.transform(F.filter(F.map_entries("details"), lambda e: e["key"].isin(*lexicon.DETAIL_KEYS)), lambda e: F.struct(e["key"].alias("key"), text.normalise(F.substring(e["value"], 1, text.DETAIL_CHARS)).alias("value"), F.substring(e["value"], 1, text.DETAIL_CHARS).alias("raw"))),
    })
    blob = F.array(
        F.col("title_n"), F.array_join("short_features", " "), F.array_join(F.array_distinct(F.flatten(F.transform("features", text.slot_tokens))), " "), F.array_join(text.slot_tokens(F.col("description")), " "),
        F.array_join("category_n", " "), F.array_join(F.transform("detail_n", lambda d: F.concat(d["key"], F.lit(" "), d["value"])), " "), F.col("store_n"),
    )
    r = r.withColumns({"text_blob": F.array_join(F.filter(blob, lambda x: x != ""), " "), "attr_phrases": F.array_sort(F.array_distinct(_phrases()))})
    return r.select("parent_asin", "title", "text_blob", "leaf_category", "category_path", "attr_phrases", "details", "price", "avg_rating", "rating_count", "store", "is_sparse", "department", "features", "description")


def searchable_text() -> Column:
    """All that a product says of itself, field by field."""
    entries = F.transform(F.map_entries("details"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.trim(F.array_join(F.flatten(F.array(F.array("title"), F.col("features"), entries, F.array("description"), F.col("category_path"), F.array("store"))), " "))


def _phrases() -> Column:
    """Everything that a product can be asked for by."""
    none = F.array().cast("array<string>")
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    detail_values = F.transform("detail_n", lambda d: d["value"])
    joined = F.transform(detail_values, lambda v: F.replace(v, F.lit(" "), F.lit("")))
    typed = F.flatten(F.transform(F.flatten(F.transform("category_n", split)), lambda t: F.when(t.isin(*[x for g in lexicon.TYPE_GROUPS for x in g]), lexicon.aliases(t)).otherwise(none)))
    gender = F.when(F.col("department") == "men", F.array(*map(F.lit, lexicon.MEN_INDEX))).when(F.col("department") == "women", F.array(*map(F.lit, lexicon.WOMEN_INDEX))).otherwise(none)
    parts = [
        F.filter("short_features", lambda f: text.is_indexable(f)),
        F.filter(detail_values, lambda v: text.is_indexable(v) | lexicon.is_slot_token(v)),
        F.filter(joined, lambda v: (v != "") & lexicon.is_slot_token(v)),
        F.filter(F.transform("detail_n", lambda d: text.normalise(F.concat(d["key"], F.lit(" "), d["raw"]))), lambda v: text.is_indexable(v)),
        F.filter(F.flatten(F.transform(detail_values, split)), lexicon.is_slot_token),
        F.filter("category_n", lambda c: text.token_count(c).between(1, 8)),
        typed,
        F.when(F.col("is_sparse"), F.filter(text.ngrams(F.col("title_n"), 2, 4), lambda g: text.is_indexable(g))).otherwise(none),
        F.filter(split(F.col("title_n")), lambda t: t.isin(*lexicon.COLORS, *lexicon.MATERIALS)),
        F.filter(F.concat(F.array("store_n"), F.filter(split(F.col("store_n")), lambda t: F.length(t) >= 3)), lambda t: t != ""),
        F.filter(F.concat(F.array("department"), gender), lambda t: t != ""),
    ]
    return F.flatten(F.array(*parts))


def card_constraints(corpus: Column, features: Column, entries: Column, price: Column) -> Column:
    """The ordered constraints of an intent card: material, colour at the second place, features, details, budget."""
    word = lambda words: F.lower(F.regexp_extract(corpus, rf"(?i)(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])", 1))
    none = F.array().cast("array<string>")
    made = lambda x: F.concat(F.when(x["material"] != "", F.array(x["material"])).otherwise(none), features, entries)
    colored = lambda color, rest: F.when(color == "", rest).otherwise(F.concat(F.slice(rest, 1, 1), F.array(F.concat(F.lit("color: "), color)), F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))))
    with_color = text.once(F.struct(word(CARD_MATERIALS).alias("material"), word(CARD_COLORS).alias("color")), lambda x: text.once(made(x), lambda rest: colored(x["color"], rest)))
    with_price = F.concat(with_color, F.when(F.coalesce(price, F.lit("")) != "", F.array(F.concat(F.lit("budget around $"), price))).otherwise(none))
    return F.array_distinct(F.filter(F.transform(with_price, lambda c: text.clean_constraint(c)), lambda x: x != ""))


def intent_card(constraints: Column, title: Column) -> Column:
    """(target_category, hard_constraints, soft_preferences)."""
    all_ = F.when(F.size(constraints) == 0, F.array(title)).otherwise(constraints)
    soft = F.slice(all_, 3, 2)
    return F.struct(title.alias("target_category"), F.slice(all_, 1, 2).alias("hard_constraints"), F.when(F.size(soft) > 0, soft).otherwise(F.slice(all_, 1, 1)).alias("soft_preferences"))


def postings(docs: DataFrame, doc: str, phrases: str) -> DataFrame:
    """(phrase, doc, position of the first appearance)."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.array_distinct(F.col(phrases))).alias("position", "phrase"))


def smoothed_idf(posted: DataFrame, n: DataFrame) -> DataFrame:
    """(phrase, df, idf) with idf = ln((n + 1) / (df + 1)) + 1 for distinct (phrase, doc); n: one row (n) with the number of
    documents."""
    df = posted.groupBy("phrase").agg(F.count("doc").alias("df"))
    return df.join(F.broadcast(n)).select("phrase", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def ranked(rows: DataFrame, by: list[Column], name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """A total order as numbers, from 1. Without groups, rows are numbered in two steps: within ranges that Spark sorts in
    parallel, then by the ranges' running counts, so that no task holds them all."""
    if within:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))
    from pyspark.sql.functions import spark_partition_id

    from plumbline.sources.tables import materialised

    placed = materialised(rows.orderBy(*by).withColumn("_part", spark_partition_id()))
    sizes = placed.groupBy("_part").count()
    # one row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_part").orderBy(*by)
    return placed.withColumn("_n", F.row_number().over(inner)).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_n")).cast("bigint")).drop("_part", "_before", "_n")


def popularity(items: DataFrame, doc: str, count: str, stars: str) -> DataFrame:
    """(doc, rank, boost): by count, then rating, then id."""
    rows = ranked(items.select(F.col(doc).alias("doc"), F.col(count).alias("n"), F.col(stars).alias("stars")), [F.desc("n"), F.desc("stars"), F.asc("doc")], "rank")
    return rows.select("doc", "rank", (0.05 * F.log1p(F.greatest("n", F.lit(0)).cast("double"))).alias("boost"))


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing, literal_none, total) of every column, in one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(f"m_{c}") for c in columns], *[F.count_if(F.col(c) == "None").alias(f"n_{c}") for c in columns])
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m_{c}").alias("missing"), F.col(f"n_{c}").alias("literal_none")) for c in columns])).alias("x")).select("x.*", "total")
