"""Counters against plain counts."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import counters


def test_counts_come_with_the_result(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("ask", F.when(F.col("id") % 5 == 0, "color").when(F.col("id") % 5 == 1, "size"))
    ran = spark.sparkContext.accumulator(0)
    once = F.udf(lambda i: ran.add(1) or i, "long").asNondeterministic()
    rows, got = counters.written(df.withColumn("id", once("id")).repartition(3), counters.asks(F.col("ask"), ("color", "size", "brand")) | {"large": F.col("id") >= 990, "unknown": F.lit(None).cast("boolean")})
    assert got == {"ask_color": 200, "ask_size": 200, "ask_brand": 0, "ask_none": 600, "large": 10, "unknown": 0}
    assert rows.count() == 1000 and ran.value == 1000  # computed once
    assert sorted(map(tuple, counters.reported(spark, got, {"large": 5}).where("counter = 'large'").collect())) == [("large", 15)]


def test_no_rows_and_no_counters(spark):
    rows, got = counters.written(spark.range(0), {"any": F.lit(True)})
    assert got == {"any": 0} and rows.columns == ["id"] and rows.isEmpty()
    assert counters.reported(spark).schema.simpleString() == "struct<counter:string,n:bigint>"
    with pytest.raises(ValueError):
        counters.written(spark.range(1), {})
