"""Cleaning, lexicons and utterances, on the published examples."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lexicon, text, utterance


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_price(spark):
    rows = ["None", "n/a", "", "free", "NaN", "inf", "true", "$12.99 - $19.99", "$18.50", "0", "1,234", None]
    assert values(spark, rows, text.price) == [None] * 7 + [12.99, 18.5, 0.0, 1234.0, None]


def test_details_and_lists(spark):
    rows = ['{"Color":"Red","Material":"Silk","Empty":""}', "not-json", "123", None]
    assert values(spark, rows, text.details) == [{"color": "Red", "material": "Silk"}, {}, {}, {}]
    assert values(spark, ['[1,"cotton",null,""]', "plain", None], text.string_list) == [["1", "cotton"], ["plain"], []]


def test_normalise(spark):
    rows = ["Description: cotton tee", "A&amp;B <b>Co</b>", "--x-- y--z", "T-Shirt,  100% Cotton!", None, ""]
    got = values(spark, rows, text.normalise)
    assert got == ["cotton tee", "a b co", "x y-z", "t-shirt 100 cotton", "", ""]
    assert values(spark, got, text.normalise) == got


def test_ngrams(spark):
    assert values(spark, ["a b c", "", "a"], lambda c: text.ngrams(c, 2, 3)) == [["a b", "b c", "a b c"], [], []]
    assert values(spark, ["cotton", "cotton crew", "a b c d e f g h i"], text.is_indexable) == [False, True, False]


def test_description(spark):
    rows = ['["Description", "soft  <b>tee</b>", "Feature:", "two"]', None, '["' + "x" * 700 + '", "y"]']
    assert values(spark, rows, text.description) == ["soft tee two", "", "x" * 600]


@pytest.mark.parametrize(("make", "rows", "want"), [
    (lexicon.canonical_gender, ["male", "for him", "boyfriend", "for her", "ladies", "blue shirt", "men and women", None], ["men", "men", "men", "women", "women", None, None, None]),
    (lexicon.guess_attribute, ["charcoal", "chiffon", "gym", "slim", "floral", "large", "eu40", "thing"], ["color", "material", "use_case", "style", "feature", "size", "size", None]),
    (text.is_decline, ["?", "huh", "what", "I don't know", "whatever you think", "what size", "blue shirt"], [True] * 5 + [False] * 2),
])
def test_lexicon(spark, make, rows, want):
    assert values(spark, rows, make) == want


def test_expand(spark):
    sneakers, blouse, shirt, none = values(spark, ["sneakers", "blouse", "shirt", ""], lexicon.expand_terms)
    assert "fashion sneakers" in sneakers and "blouses button-down shirts" in blouse and "t-shirts" in shirt and "blouses button-down shirts" not in shirt and none == []


EVENTS = [
    ("I'm looking for Hoop. A key requirement is: Spandex.", ("opening", "Hoop", ["Spandex"], None, "buying")),
    ("I'm looking for Hoop, but I'm still exploring.", ("opening", "Hoop", [], None, "browsing")),
    ("I'm looking for Shoes. Prefer something black.", ("opening", "Shoes", ["Prefer something black."], None, "intent_override")),
    ("For that, what matters is: budget around $19.99; cotton.", ("disclosure", None, ["budget around $19.99", "cotton"], None, None)),
    ("um, What matters is: leather; 100% Leather, for that", ("disclosure", None, ["leather", "100% Leather"], None, None)),
    ("What I need is: leather. Actually, ignore my earlier preference if that makes sense", ("override", None, ["leather"], None, None)),
    ("um, I'm still exploring, but I'm looking for Basketball Men", ("opening", "Basketball Men", [], None, "browsing")),
    ("I don't have an additional preference for color.", ("exhausted", None, [], "color", None)),
    ("I don't have a preference for size; please use your judgment.", ("no_preference", None, [], "size", None)),
    (utterance.REBUKE, ("rebuke", None, [], None, None)),
    ("hello", ("unknown", None, [], None, None)),
    (None, ("unknown", None, [], None, None)),
]


def test_events(spark):
    got = values(spark, [m for m, _ in EVENTS], utterance.parse_event)
    assert [(e.kind, e.category, e.constraints, e.attribute, e.scenario_hint) for e in got] == [w for _, w in EVENTS]
