"""Every query with a DuckDB counterpart gives the same rows at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_parity import TABLES, canonical


@pytest.fixture(scope="module")
def duck(smoke_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{smoke_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, smoke_dir, name):
    got = entry.queries()[name](spark, smoke_dir).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))


def test_entry_scores_the_test_pairs(spark, smoke_dir):
    out = entry.entry(spark)
    assert out.columns == ["id", "pred"]
    assert out.count() == entry.src.test(spark, smoke_dir).count() > 0
    assert out.filter("pred < 0 OR pred IS NULL").isEmpty()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
