"""Cleaning of records and texts as Column expressions; one UDF for what has no expression, the full set of HTML entities."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions import lexicon

# Words that mark missing entries, boilerplate tokens, and lengths.
MISSING = ("none", "nan", "null", "n/a", "na", "nil", "")
BOILERPLATE = ("description", "feature", "features", "package", "packaging", "including", "includes", "specification", "specifications", "spec", "specs")
HEADERS = ("description", "feature", "features", "package including", "package includes", "specifications", "specification")
FEATURE_CHARS, DESCRIPTION_CHARS, DETAIL_CHARS, SHORT_FEATURE_TOKENS = 180, 600, 120, 10
BASELINE_STOP = tuple("""a an and are as at be but by for from i in is it me my of on or please some that the this to want with
would you looking""".split())
ROOT_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
#: The entities that texts really hold; the UDF knows all.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# End of the fixed values.



@F.pandas_udf(StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def strip_html(text: Column, full: bool = False) -> Column:
    """Tags become spaces, entities their characters; `full` decodes all entities, in Arrow batches."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    if full:
        return F.when(out.contains("&"), unescape_all(out)).otherwise(out)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column, full: bool = False) -> Column:
    """The one normaliser of phrases, at index and at query time: no tags, lower case, letters, digits, underscores and
    hyphens within words only, single spaces, no boilerplate tokens. Null gives the empty string."""
    s = F.lower(strip_html(F.coalesce(text, F.lit("")), full))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s-]", " ")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), r"\s+", " ")
    s = F.regexp_replace(s, r"(?<![^ ])[-_]+|[-_]+(?![^ ])", "")  # at the edges of words
    s = F.regexp_replace(s, rf"(?<![^ ])(?:{'|'.join(BOILERPLATE)})(?![^ ])", "")
    return F.trim(F.regexp_replace(s, " {2,}", " "))


def token_count(normalised: Column) -> Column:
    return F.when(normalised == "", 0).otherwise(F.size(F.split(normalised, " ")))


def is_indexable(normalised: Column, least: int = 2, most: int = 8) -> Column:
    return token_count(normalised).between(least, most)


def ngrams(normalised: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` tokens, by length, then place."""
    parts = F.when(normalised == "", F.array().cast("array<string>")).otherwise(F.split(normalised, " "))
    size = F.size(parts)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(least, most + 1)]))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is made once, however often it is read: within arrays Spark makes it anew each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct words of ASCII letters and digits of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def query_terms(text: Column, stop: tuple[str, ...] = BASELINE_STOP) -> Column:
    """Words of two characters at least that are no stop words, in order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def slot_tokens(text: Column) -> Column:
    """Distinct lexicon tokens of a text, also in their form without hyphens."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9-]*"), F.lit(0))

    def value(raw: Column) -> Column:
        t = F.regexp_replace(raw, "^[-_]+|[-_]+$", "")
        plain = F.replace(t, F.lit("-"), F.lit(""))
        return F.when(lexicon.is_slot_token(t), t).when(lexicon.is_slot_token(plain), plain)

    return F.array_distinct(F.array_compact(F.transform(found, value)))


def _missing(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*MISSING)


def price(text: Column) -> Column:
    """The first number of a price as text; ranges give their low end, words for missing give null."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(~_missing(text) & ~F.lower(text).isin("true", "false", "inf", "-inf", "infinity"), F.nullif(number, F.lit("")).cast("double"))


def _number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(text).try_cast("double"))


def rating(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(_number(text), F.lit(default))


def rating_count(text: Column) -> Column:
    return F.greatest(F.coalesce(_number(text).try_cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def string_list(text: Column) -> Column:
    """A JSON list's or a plain value's non-empty strings."""
    parts = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(text, "array<string>"), F.array(text)))
    return F.filter(F.transform(F.array_compact(parts), lambda x: F.trim(x)), lambda x: x != "")


def details(text: Column) -> Column:
    """A JSON object (or a JSON string of one) as a map: keys lower-cased and sorted, empty and missing values dropped; of
    keys that become equal the last wins."""
    entries = F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("o"), F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))))
    good = F.filter(ordered, lambda e: (e["key"] != "") & e["value"].isNotNull() & ~F.lower(e["value"]).isin(*MISSING))
    last = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def description(text: Column) -> Column:
    """Cleaned parts, without headers, until DESCRIPTION_CHARS are reached."""
    parts = F.transform(string_list(text), lambda p: collapse(strip_html(F.substring(p, 1, DESCRIPTION_CHARS))))
    good = F.filter(parts, lambda p: (p != "") & ~F.regexp_replace(F.lower(p), "^[ :]+|[ :]+$", "").isin(*HEADERS))
    whole = F.aggregate(good, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), lambda a, p: F.when(a["n"] >= DESCRIPTION_CHARS, a).otherwise(F.struct(F.concat(a["s"], F.when(a["s"] == "", "").otherwise(" "), p).alias("s"), (a["n"] + F.length(p)).alias("n"))))
    return F.substring(whole["s"], 1, DESCRIPTION_CHARS)


def clean_constraint(text: Column, limit: int = FEATURE_CHARS) -> Column:
    return F.rtrim(F.substring(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ \-;,.]+|[ \-;,.]+$", ""), 1, limit))


def key_values(entries: Column) -> Column:
    """`key: value` of each entry of a map, in order, without empty values."""
    return F.transform(F.filter(F.map_entries(entries), lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))


def coarse_category(path: Column) -> Column:
    """The last two parts of a category path below its roots."""
    parts = F.transform(F.flatten(F.transform(path, lambda p: F.split(p, ","))), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*ROOT_CATEGORIES))
    return F.when(F.size(good) == 0, "clothing item").otherwise(F.array_join(F.slice(good, F.greatest(F.size(good) - 1, F.lit(1)), 2), " "))


def is_decline(text: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    padded = F.concat(F.lit(" "), normalise(text), F.lit(" "))
    out = raw.isin(*lexicon.DECLINES)
    for cue in lexicon.DECLINE_CUES:
        out = out | padded.contains(f" {cue.replace(chr(39), ' ')} ")
    return out
