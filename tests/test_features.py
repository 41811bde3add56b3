import math

import pytest
from pyspark.sql import functions as F

import standins
from sharewise.operators.features import activity_features, ratio_features, temporal_features
from sharewise.operators.folds import assign_folds, fold_scores, mean_baseline, score_summary
from sharewise.operators.importance import gain_share, top_features
from sharewise.plans.features import (
    MISSING,
    SHORT_FEATURES,
    TRAINING_FEATURES,
    fill_missing,
    numeric_columns,
    pair_features,
)


@pytest.fixture(scope="module")
def frame(spark, smoke_dir):
    return pair_features(
        standins.mirrored(spark, smoke_dir),
        standins.dimension(spark, smoke_dir),
        standins.AS_OF,
    )


def test_feature_lists_exist_in_the_frame(frame):
    assert (len(TRAINING_FEATURES), len(SHORT_FEATURES)) == (68, 42)
    assert len(set(TRAINING_FEATURES)) == 68
    assert set(TRAINING_FEATURES) | set(SHORT_FEATURES) <= set(frame.columns)


def test_a_share_and_its_mirror_add_up_to_one(frame):
    pairs = frame.select("id", "project_a", "project_b", "stars_ratio").filter(
        F.col("stars_ratio").isNotNull() & ~F.isnan("stars_ratio")
    )
    back = pairs.select(
        "id",
        F.col("project_b").alias("project_a"),
        F.col("project_a").alias("project_b"),
        F.col("stars_ratio").alias("back"),
    )
    both = pairs.join(back, ["id", "project_a", "project_b"])
    assert both.count() == pairs.count() > 0
    assert both.filter(F.abs(F.col("stars_ratio") + F.col("back") - 1) > 1e-12).isEmpty()


def test_zero_over_zero_stays_apart_from_unmatched(spark):
    counts = ["stars", "watchers", "forks", "size", "open_issues", "subscribers_count"]
    columns = [f"{c}{s}" for c in counts for s in ("", "_b")]
    schema = ", ".join(f"{c} long" for c in columns) + ", age_days double, age_days_b double"
    df = spark.createDataFrame(
        [(0,) * 12 + (None, 2.0), (None,) * 12 + (None, None)], schema
    )
    zero, gone = ratio_features(df).collect()
    assert math.isnan(zero.stars_ratio) and gone.stars_ratio is None
    assert (zero.stars_per_day, zero.log_stars, gone.log_stars) == (0.0, 0.0, 0.0)
    assert gone.stars_forks_interaction is None
    days = df.withColumns({f"days_since_update{s}": F.lit(10) for s in ("", "_b")})
    zero, gone = activity_features(days).collect()
    assert (zero.stars_decay_0_01, gone.stars_decay_0_01) == (0.0, None)
    assert gone.stars_issues_interaction == 0


def test_filled_columns_have_no_gaps(frame):
    table = numeric_columns(frame, TRAINING_FEATURES, ["id"])
    filled = fill_missing(table, TRAINING_FEATURES)
    bad = [F.col(c).isNull() | F.isnan(c) for c in filled.columns if c != "id"]
    assert filled.filter(F.greatest(*[b.cast("int") for b in bad]) == 1).isEmpty()
    gaps = table.filter(F.col("stars_ratio").isNull()).count()
    flagged = filled.filter((F.col("stars_ratio") == MISSING) & (F.col("stars_ratio_missing") == 1))
    assert flagged.count() == gaps > 0


def test_a_pair_and_its_mirror_share_a_fold(frame):
    by_id = assign_folds(frame.select("id", "project_a", "project_b"))
    assert by_id.groupBy("id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert {r.fold for r in by_id.select("fold").distinct().collect()} == set(range(5))
    by_row = assign_folds(frame.select("id", "project_a", "project_b"), by="row")
    split = by_row.groupBy("id").agg(F.countDistinct("fold").alias("n")).filter("n > 1")
    assert not split.isEmpty()


def test_baseline_predicts_the_other_folds(spark):
    rows = [(0, 0.0), (0, 1.0), (1, 0.5), (2, 0.75)]
    df = mean_baseline(spark.createDataFrame(rows, "fold int, weight_a double"))
    got = {(r.fold, r.weight_a): r.prediction for r in df.collect()}
    assert got[0, 0.0] == pytest.approx(0.625) and got[1, 0.5] == pytest.approx(1.75 / 3)
    scores = fold_scores(df)
    mses = [r.mse for r in scores.collect()]
    summary = score_summary(scores).first()
    mean = sum(mses) / 3
    assert summary.mean_mse == pytest.approx(mean)
    assert summary.std_mse == pytest.approx(math.sqrt(sum((m - mean) ** 2 for m in mses) / 3))


def test_gain_shares(spark):
    gains = spark.createDataFrame(
        [("a", 98.0), ("b", 1.0), ("c", 1.0)], "feature string, gain double"
    )
    got = {r.feature: (r.gain_share, r.selected) for r in gain_share(gains).collect()}
    assert got == {"a": (0.98, True), "b": (0.01, False), "c": (0.01, False)}
    assert [r.feature for r in top_features(gains, 2).collect()] == ["a", "b"]
    empty = gain_share(gains.withColumn("gain", F.lit(0.0)))
    assert empty.filter("selected").isEmpty()


def test_stateless_steps_run_on_a_stream(spark, smoke_dir, tmp_path):
    schema = "created_at string, updated_at string, created_at_b string, updated_at_b string"
    row = ("2001-01-01T00:00:00Z", "2001-01-02T00:00:00Z", None, None)
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        temporal_features(stream, standins.AS_OF)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().days_since_update == 364
