import json

import pytest
from pyspark.sql import functions as F

from sharewise import schemas, session
from sharewise.operators.metadata import project_dimension
from sharewise.plans import funding
from sharewise.sources import sinks, tables
from sharewise.sources.snapshots import is_complete, materialize_once


def test_pairs_are_built_once_and_only_together(spark, pair_frame, tmp_path):
    calls = []

    def train():
        calls.append("train")
        return pair_frame([(1, "https://github.com/a/b", "c/d", 0.25, 0.75)])

    def test():
        calls.append("test")
        return pair_frame([(2, "x/y", "https://github.com/c/d", None, None)]).drop(
            "weight_a", "weight_b"
        )

    raw = str(tmp_path / "raw")
    for _ in range(2):
        got = tables.load_pairs(spark, raw, train, test)
        assert [tuple(r) for r in got[0].collect()] == [(1, "a/b", "c/d", 0.25, 0.75)]
        assert [tuple(r) for r in got[1].collect()] == [(2, "x/y", "c/d")]
    assert calls == ["train", "test"]
    # Files without a success marker (copied in by hand) are a hit too, and never replaced.
    (tmp_path / "raw" / "test" / "_SUCCESS").unlink()
    tables.load_pairs(spark, raw, train, test)
    assert calls == ["train", "test"]
    plain = tables.read_pairs_csv(spark, f"{raw}/dataset").first()
    assert plain.project_a == "https://github.com/a/b"


def test_snapshot_hit_ignores_the_builder(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert not is_complete(spark, path)
    assert materialize_once(spark, path, lambda: spark.range(3)).count() == 3
    assert materialize_once(spark, path, lambda: spark.range(9)).count() == 3


def landed(tmp_path, name, records):
    path = tmp_path / f"{name}.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def test_metadata_refresh_asks_only_for_what_is_missing(spark, tmp_path):
    asked = []
    answers = {
        "a/b": {"full_name": "A/b", "stargazers_count": 5, "extra": [1]},
        "c/d": {"full_name": "c/d", "stargazers_count": 7},
        "gone/gone": {},
    }

    def fetch(wanted):
        names = sorted(r.project for r in wanted.collect())
        asked.append(names)
        path = landed(tmp_path, f"batch{len(asked)}", [answers[n] for n in names])
        return tables.read_metadata_json(spark, path)

    def projects(*names):
        return spark.createDataFrame([(n,) for n in names], "project string")

    snapshot = str(tmp_path / "meta")
    first = tables.refresh_metadata(spark, snapshot, projects("a/b", "gone/gone"), fetch)
    assert [r.full_name for r in first.collect()] == ["A/b"]
    second = tables.refresh_metadata(spark, snapshot, projects("a/b", "c/d"), fetch)
    assert asked == [["a/b", "gone/gone"], ["c/d"]]
    assert second.schema == schemas.REPO_METADATA
    stars = {r.project_id: r.stars for r in project_dimension(second).collect()}
    assert stars == {"a/b": 5, "c/d": 7}


def test_metadata_refresh_lands_a_key_once(spark, tmp_path):
    asked = []

    def fetch(wanted):
        names = sorted(r.project for r in wanted.collect())
        asked.append(names)
        records = [{"full_name": "New/Name" if n == "old/name" else n} for n in names * 2]
        return tables.read_metadata_json(spark, landed(tmp_path, f"b{len(asked)}", records))

    both = spark.createDataFrame([("Foo/Bar",), ("foo/bar",), ("old/name",)], "project string")
    snapshot = str(tmp_path / "meta")
    for _ in range(2):
        got = tables.refresh_metadata(spark, snapshot, both, fetch)
        assert sorted(r.full_name for r in got.collect()) == ["New/Name", "foo/bar"]
    assert asked[0] == ["foo/bar", "old/name"]


def test_a_missing_prediction_stays_missing(spark):
    df = spark.createDataFrame([(1, None), (2, -0.5)], "id long, prediction double")
    assert {r.id: r.pred for r in sinks.submission(df).collect()} == {1: None, 2: 0.0}


def test_submission_sink_keeps_metrics_beside(spark, tmp_path):
    df = spark.createDataFrame([(1, -0.1), (2, 1.3)], "id long, prediction double")
    metrics = spark.createDataFrame([(0.5,)], "mean_mse double")
    path = str(tmp_path / "sub")
    sinks.write_submission(df, path, metrics)
    back = spark.read.schema("id long, pred double").option("header", True).csv(path)
    assert sorted(map(tuple, back.collect())) == [(1, 0.0), (2, 1.3)]
    assert spark.read.json(path + "_metrics").first().mean_mse == 0.5


def test_sweep_sink_prunes_by_alpha(spark, tmp_path):
    df = spark.createDataFrame(
        [(0.0, 1, 0.5), (0.001, 1, 0.75)], "alpha double, id long, prediction double"
    )
    stats = spark.createDataFrame([(0.0, 0.1, 0.9)], "alpha double, mse double, error_corr double")
    sinks.write_sweep(df, stats, str(tmp_path / "sweep"))
    schema = "id long, pred double, alpha double"
    back = spark.read.schema(schema).option("header", True).csv(str(tmp_path / "sweep/submissions"))
    one = back.filter(F.col("alpha") == 0.001)
    assert [tuple(r) for r in one.collect()] == [(1, 0.75, 0.001)]
    assert "PartitionFilters: [isnotnull(alpha" in one._jdf.queryExecution().toString()


FUNDING = [
    ("2020-01-15 00:00:00", "f", "pool", "p", 1, 1.25),
    ("2020-03-31 23:00:00", "f", "pool", "p", 1, 1.25),
    ("2020-04-01 00:00:00", "f", "pool", "p", 1, -2.5),
    ("2020-04-01 00:00:00", "f", "pool", "q", 2, 9.0),
]
REPOS = [(1, "u/a", 5), (1, "u/b", 5), (1, "u/c", None), (3, "u/d", 1), (4, "u/e", None)]


@pytest.fixture(scope="module")
def warehouse(spark):
    facts = spark.createDataFrame(
        FUNDING,
        "time string, from_project_name string, grant_pool_name string, "
        "to_project_name string, to_project_id long, amount double",
    ).withColumn("time", F.col("time").cast("timestamp_ntz"))
    repos = spark.createDataFrame(
        REPOS, "project_id long, artifact_url string, star_count long"
    )
    return facts, repos


def test_funding_rounds_half_away_from_zero(warehouse):
    got = sorted(
        (str(r.quarter)[:10], r.project, r.total_funding_usd)
        for r in funding.funding_by_quarter(warehouse[0]).collect()
    )
    assert got == [("2020-01-01", "p", 3), ("2020-04-01", "p", -3), ("2020-04-01", "q", 9)]


def test_top_repo_breaks_ties_and_skips_unknown_stars(warehouse):
    got = {r.project_id: r.project_repo for r in funding.top_repo(warehouse[1]).collect()}
    assert got == {1: "u/b", 3: "u/d", 4: None}
    only = funding.top_repo(warehouse[1], ["u/a", "u/d"]).collect()
    assert {r.project_id: r.project_repo for r in only} == {1: "u/a", 3: "u/d"}


def test_report_drops_the_id_and_projects_without_repo(warehouse):
    report = funding.funding_with_repo(*warehouse)
    assert report.columns == [
        "quarter", "funder", "grant_pool_name", "project", "total_funding_usd", "project_repo",
    ]
    assert {(r.project, r.project_repo) for r in report.collect()} == {("p", "u/b")}
    assert funding.preview(report, 1).count() == 1


def test_report_as_sql_over_named_tables(spark, warehouse, tmp_path):
    warehouse[0].write.parquet(str(tmp_path / "funding"))
    facts = tables.read_warehouse_table(spark, str(tmp_path / "funding"), "oss_funding")
    assert facts.schema == schemas.OSS_FUNDING
    text = "SELECT * EXCEPT (to_project_id) FROM {facts} WHERE to_project_id = 2"
    rows = tables.warehouse_query(spark, text, facts=facts).collect()
    assert [(r.to_project_name, r.amount) for r in rows] == [("q", 9.0)]


def test_checkpoint_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_root(spark) == named
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    staged = session.stage(spark.range(5), "five")
    assert staged.count() == 5
    assert all(named in f for f in staged.inputFiles())
