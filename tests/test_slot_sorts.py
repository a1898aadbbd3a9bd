"""The slots at the end: the category before is found in the order of the session, without a sort of its own."""

from plumbline.operators import sessions


def test_one_lag_and_null_categories(spark):
    rows = [("a", 1, "category", "x", 1.0), ("a", 2, "size", "1", 0.5), ("a", 3, "category", None, 1.0), ("a", 4, "category", "y", 1.0), ("a", 5, "size", "2", 0.25), ("b", 1, "size", "3", 0.5), ("b", 2, "category", "x", 1.0), ("b", 3, "color", "4", 0.5), ("b", 4, "category", "y", 1.0), ("b", 5, "size", "5", 0.5)]
    got = sessions.category_slots(spark.createDataFrame(rows, "session string, at int, attribute string, value string, confidence double"))
    # a null category clears nothing, nor does the one after it
    assert {(r.session, r.category, r.attribute, r.value, tuple(r.superseded)) for r in got.collect()} == {("a", "y", "size", "2", ("1",)), ("b", "y", "size", "5", ())}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lag(value") == 1  # the attributes' own
