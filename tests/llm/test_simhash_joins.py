"""Keys of fingerprints, and what is counted of them, are not broadcast for Catalyst's estimate."""

import pytest
from pyspark.sql import functions as F

from sharewise.llm import components, simhash
from sharewise.operators import joins


def run_plan(df):
    """The plan as it ran, after adaptive execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exploded(df, times):
    return df.select("id", F.explode(F.array(*[F.lit(i) for i in range(times)])).alias("way"))


def test_an_exploded_table_is_as_large_as_its_rows(spark):
    small = spark.range(500_000)  # 4 MB
    assert joins.fits_broadcast(small) and joins.fits_broadcast(exploded(small, 2))
    assert not joins.fits_broadcast(exploded(small, 24))
    assert not joins.fits_broadcast(exploded(exploded(small, 2).drop("way"), 2))
    unknown = small.select(F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("id"))
    assert not joins.fits_broadcast(unknown)


def test_a_lookup_exploded_beyond_the_limit_is_shuffled(spark):
    facts = spark.range(100)
    lookup = exploded(spark.range(500_000), 24).groupBy("id").agg(F.count("*").alias("n"))
    found = joins.lookup_join(facts, lookup, "id", ["id"])
    assert "SortMergeJoin" in run_plan(found) and "BroadcastHashJoin" not in run_plan(found)
    assert {r.n for r in found.collect()} == {24} and found.count() == 100


@pytest.fixture
def staged(monkeypatch):
    """Tables as they come to be staged."""
    seen, stage = [], simhash.stage

    def caught(df, name):
        seen.append(df)
        return stage(df, name)

    monkeypatch.setattr(simhash, "stage", caught)
    monkeypatch.setattr(components, "stage", caught)
    return seen


def test_no_table_of_the_search_is_broadcast(spark, staged):
    rows = [(i, " ".join(f"w{(i // 3) * 7 + k}" for k in range(20))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs)
    plans = [run_plan(df) for df in [*staged, found]]
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert any("SortMergeJoin" in p for p in plans)
    groups = {(r.doc_id // 3, r.component_id) for r in found.collect()}
    assert {(k, 3 * k) for k in range(30)} == groups
