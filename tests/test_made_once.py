"""Rows that a query reads more than once are derived once."""

import __spark_entry__ as entry


def counted(spark, df):
    """``df``, and how many of its rows have been made."""
    made = spark.sparkContext.accumulator(0)

    def one(row):
        made.add(1)
        return row

    return spark.createDataFrame(df.rdd.map(one), df.schema), made


def test_facts_are_joined_once_for_all_batches(spark, monkeypatch):
    facts = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-05' + make_dt_interval(30 * id) AS time, 'f' AS from_project_name,"
        " 'g' AS grant_pool_name, 'p' AS to_project_name, id AS to_project_id, id * 1.5D AS amount FROM range(12)"
    )
    df, made = counted(spark, facts)
    monkeypatch.setattr(entry.src, "oss_funding", lambda spark, sf: df)
    want = entry.funding.funding_by_quarter(facts).collect()
    got = entry.funding_refresh(spark, "").select("quarter", "funder", "grant_pool_name", "project", "to_project_id", "total_funding_usd")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want)))
    assert made.value == 12


def test_expanded_rows_are_made_once(spark, monkeypatch, pair_frame):
    pairs = pair_frame([(i, f"p{i % 3}", f"q{i}", i / 20, 1 - i / 20) for i in range(10)])
    df, made = counted(spark, pairs)
    monkeypatch.setattr(entry.src, "mirrored", lambda spark, sf: df)
    got = entry.expanded_summary(spark, "").first()
    assert got == entry.rounded(entry.target.expanded_summary(pairs, "a")).first()
    assert made.value == 10
