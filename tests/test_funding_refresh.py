"""A report kept up to date by batches equals one worked out from all facts."""

import os

from sharewise.plans import funding

SHAPE = (
    "time timestamp_ntz, from_project_name string, grant_pool_name string, to_project_name string, "
    "to_project_id bigint, amount double"
)


def facts(spark, *rows):
    text = ", ".join(
        f"({'NULL' if day is None else f'TIMESTAMP_NTZ {day!r}'}, 'f', 'g', 'p', CAST({p} AS BIGINT), "
        f"CAST({amount} AS DOUBLE))" for day, p, amount in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(c.split()[0] for c in SHAPE.split(', '))})")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def written(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")
    }


def test_batches_equal_a_full_run(spark, tmp_path):
    path = str(tmp_path / "funding")
    one = facts(spark, ("2024-01-05", 1, 10.4), ("2024-05-01", 1, 7.0), (None, 2, 1.0))
    two = facts(spark, ("2024-02-07", 1, 10.4), ("2024-08-01", 3, 5.0))
    assert rows_of(funding.refresh_funding(spark, path, "a", one)) == rows_of(funding.funding_by_quarter(one))
    before = written(f"{path}/report")
    got = rows_of(funding.refresh_funding(spark, path, "b", two))
    assert got == rows_of(funding.funding_by_quarter(one.union(two)))
    after = written(f"{path}/report")
    same = {f for f in before if before[f] == after.get(f)}
    assert {f.split("part=")[1].split("/")[0] for f in same} == {"2024Q2", "none"}  # left as they were
    assert rows_of(funding.refresh_funding(spark, path, "b", two)) == got
    assert rows_of(funding.refresh_funding(spark, path, "c", two.filter("false"))) == got


def test_no_facts_at_all(spark, tmp_path):
    none = facts(spark, (None, 1, 1.0)).filter("false")
    got = funding.refresh_funding(spark, str(tmp_path / "f"), "a", none)
    assert got.collect() == [] and got.columns == funding.funding_by_quarter(none).columns
