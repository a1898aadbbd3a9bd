"""Queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans.registry import ORACLE, QUERIES


def canonical(df):
    return sorted(repr(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, oracle, name):
    assert canonical(QUERIES[name](spark, sf).toPandas()) == canonical(oracle.sql(ORACLE[name]).df())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query", "doc", "tier", "place"] and rows.groupBy("query").count().where("count <> 10").isEmpty()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
