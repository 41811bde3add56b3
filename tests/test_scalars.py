import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sharewise.functions import clip_low, parse_iso, project_id, ratio, whole_days
from sharewise.operators.features import temporal_features
from sharewise.sources.sinks import submission


def one(spark, expression, **values):
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return row.select(expression.alias("out")).first().out


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://github.com/a/b", "a/b"),
        ("a/b", "a/b"),
        ("https://github.com/x/github.com/y", "y"),
        ("", ""),
        (None, None),
    ],
)
def test_project_id_is_the_text_after_the_last_delimiter(spark, url, want):
    assert one(spark, project_id(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize(
    "n, d, want",
    [
        (1, 0, math.inf),
        (-1, 0, -math.inf),
        (1, 4, 0.25),
        (None, 1, None),
        (1, None, None),
        (None, 0, None),
    ],
)
def test_ratio(spark, n, d, want):
    assert one(spark, ratio(F.lit(n).cast("long"), F.lit(d).cast("long"))) == want


def test_ratio_of_zeros_is_nan(spark):
    assert math.isnan(one(spark, ratio(F.lit(0), F.lit(0))))


@pytest.mark.parametrize(
    "end, want",
    [
        ("2001-01-01 23:59:00", 0),
        ("2001-01-02 01:00:00", 1),
        ("2000-12-30 23:00:00", -1),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_whole_days_truncate_toward_zero(spark, end, want, zone):
    start = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, whole_days(start, F.lit(end).cast("timestamp_ntz"))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bad_timestamp_text(spark):
    assert one(spark, parse_iso(F.lit("yesterday"), strict=False)) is None
    with pytest.raises(PySparkException):
        one(spark, parse_iso(F.lit("yesterday")))


@pytest.mark.parametrize(
    "value, want", [(-0.1, 0.0), (1.3, 1.3), (0.1234565, 0.123457), (-1e-9, 0.0)]
)
def test_clip_has_no_upper_bound(spark, value, want):
    assert one(spark, clip_low(F.lit(value))) == want


def test_submission_keeps_the_id_with_its_row(spark):
    df = spark.createDataFrame([(7, 0.5), (3, -2.0)], "id long, prediction double")
    assert {tuple(r) for r in submission(df).collect()} == {(7, 0.5), (3, 0.0)}


def dated(spark, created, updated):
    return spark.createDataFrame(
        [(created, updated, None, None)],
        "created_at string, updated_at string, created_at_b string, updated_at_b string",
    )


def test_age_is_a_million_times_the_days_unless_true_days(spark):
    df = dated(spark, "2001-01-01T00:00:00Z", "2001-01-02T00:00:00Z")
    as_of = "2002-01-01 12:00:00"
    assert temporal_features(df, as_of).first().age_days == 1_000_000
    row = temporal_features(df, as_of, true_days=True).first()
    assert (row.age_days, row.days_since_update) == (1, 364)
    assert (row.age_days_b, row.days_since_update_b, row.created_dt_b) == (None, None, None)


def test_update_after_the_reference_time_is_negative(spark):
    df = dated(spark, "2001-01-01T00:00:00Z", "2002-01-04T00:00:00Z")
    assert temporal_features(df, "2002-01-01 12:00:00").first().days_since_update == -2


def test_temporal_features_need_both_timestamps(spark):
    df = spark.createDataFrame([("x",)], "created_at string")
    assert temporal_features(df, "2002-01-01 12:00:00").columns == ["created_at"]
