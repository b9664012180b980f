"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    found = duckdb.connect()
    for file in sorted(os.listdir(small)):
        found.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{small}/{file}')")
    return found


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, small, duck):
    found = entry.queries()[name](spark, small)
    result = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(result.columns)
    mine = sorted(tuple(plain(x[c]) for c in columns) for x in found.collect())
    theirs = sorted(tuple(map(plain, x)) for x in result.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == theirs


def test_queries_whose_rows_are_few_have_some(spark, small):
    assert entry.queries()["gone_paths"](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only_queries(spark, small):
    assert entry.queries()["leader_clusters"](spark, small).count() == 1000
