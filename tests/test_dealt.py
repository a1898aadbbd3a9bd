"""A file of one row group is read by one task; what is made from its rows is not."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.plans import understanding
from plumbline.sources import tables


@pytest.mark.parametrize("query", ["constraint_classes", "product_records", "constraint_extraction"])
def test_one_row_group_is_worked_on_by_all_tasks(spark, tmp_path, query):
    p = spark.range(4000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("red ring "), F.col("id") % 9).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(3).alias("p_size"), F.lit(9.5).alias("p_retailprice"))
    p.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert tables.table(spark, str(tmp_path), "part").rdd.getNumPartitions() == 1
    # what constraint_extraction gives is little, so its last stage may be one task; its texts are made before
    rows = understanding.part_utterances(spark, str(tmp_path))[0] if query == "constraint_extraction" else __spark_entry__.queries()[query](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_dealt_keeps_all_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (2, 2), (3, 3)], "k int, v int").coalesce(1)
    assert sorted(map(str, tables.dealt(rows, "k").collect())) == sorted(map(str, rows.collect()))
