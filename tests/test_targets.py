"""A table in a small file may have very many rows: it is exchanged where it meets others, not sent whole through the driver."""

from plumbline.plans import search, simulation


def test_customers_are_not_broadcast(spark, sf):
    rows = search.part_features(spark, sf)  # turns by query, cards by doc
    assert rows._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
    samples = simulation.customer_samples(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert samples.count("SortMergeJoin") == 1


def test_a_cell_sorts_its_ids_once():
    """A target is found by its place in the sorted ids; the cell's rows need not be in order of all ids."""
    import numpy as np
    import pyarrow as pa

    from plumbline.operators.pool import Cell

    for ids in (pa.array([3, 30, 31, 5, 40, 7]), pa.array(["c", "x", "y", "e", "z", "g"])):
        cell = Cell(3, {}, {}, {}, None)
        all_ = ids.to_pylist()
        for i, x in enumerate(all_):
            assert cell.places(ids, np.array([x])).tolist() == [i]
        kept = cell.sorted_ids
        assert cell.places(ids, np.array([all_[4], type(all_[0])("0"), all_[1]])).tolist() == [4, -1, 1] and cell.sorted_ids is kept
    assert Cell(0, {}, {}, {}, None).places(pa.array([], pa.int64()), np.array([4])).tolist() == [-1]


def test_wide_rows_are_written_small(spark):
    from pyspark.sql import functions as F

    from plumbline.sources import tables

    df = spark.range(100).select("id", F.array(F.lit("a"), F.lit(None)).alias("x"), F.lit(1.5).alias("y"))
    got = tables.written(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect())) and got.columns == df.columns and "FileScan parquet" in got._jdf.queryExecution().executedPlan().toString()
