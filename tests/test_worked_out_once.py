"""What belongs to a project or a pair is worked out there, not for every mirrored row."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
import standins
from sharewise.operators.features import RATES, SIDES, dated_rates, project_rates
from sharewise.operators.metadata import attach_metadata
from sharewise.operators.pairs import mirror_sides
from sharewise.plans import boosting
from sharewise.plans.boosting import Model, Tree
from sharewise.plans.features import pair_features


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rates_are_rounded_before_they_are_looked_up(spark, smoke_dir):
    text = optimized(entry.queries()["rate_features"](spark, smoke_dir))
    assert text.index("Join LeftOuter") < text.index("round(")


def test_features_of_one_side_are_made_before_pairs_are_mirrored(spark, smoke_dir):
    df = pair_features(
        standins.compared(spark, smoke_dir), standins.dimension(spark, smoke_dir),
        standins.AS_OF, mirrored=True,
    )
    text = optimized(df.select("id", "stars_decay_0_01", "log_forks_b", "stars_ratio")).lower()
    assert "generate explode" in text and "exp(" in text
    assert text.index("generate explode") < text.index("exp(")


def test_decayed_counts_change_sides(spark):
    df = spark.createDataFrame(
        [(1, "p", "q", 1.0, 2.0)],
        "id int, project_a string, project_b string, stars_decay_0_01 double, stars_decay_b_0_01 double",
    )
    rows = mirror_sides(df, {"stars_decay_0_01": "stars_decay_b_0_01"}).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [("p", "q", 1.0, 2.0), ("q", "p", 2.0, 1.0)]


DAY = "2001-01-0{}T00:00:00Z"
ROWS = "project_id string, created_at string, updated_at string, stars bigint, forks bigint, "
ROWS += "watchers bigint, subscribers_count bigint"


@pytest.fixture
def dated(spark):
    rows = [
        ("p", DAY.format(1), DAY.format(3), 6, 0, 1, 1), ("q", None, DAY.format(3), None, 5, 1, 1),
        ("bad", "yesterday", DAY.format(3), 1, 1, 1, 1),
    ]
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("ends", [("p", "q"), ("q", "p"), ("p", "gone"), ("gone", "q")])
def test_rates_of_projects_are_those_of_pairs(pair_frame, dated, ends):
    pairs = pair_frame([(1, *ends, 0.5, 0.5)])
    names = [n + side for n in RATES for side in SIDES]
    found = dated_rates(attach_metadata(pairs, project_rates(dated, standins.AS_OF)))
    late = dated.withColumns({c: F.lit(1) for c in ("open_issues", "size")})
    plain = pair_features(pairs, late, standins.AS_OF)
    assert found.select(names).collect() == plain.select(names).collect()


def test_only_a_pair_that_mentions_a_bad_date_stops_the_job(pair_frame, dated):
    rates = project_rates(dated, standins.AS_OF)
    assert dated_rates(attach_metadata(pair_frame([(1, "p", "q", 0.5, 0.5)]), rates)).collect()
    for ends in (("bad", "p"), ("p", "bad")):
        df = dated_rates(attach_metadata(pair_frame([(1, *ends, 0.5, 0.5)]), rates))
        with pytest.raises(PySparkException):
            df.collect()


@pytest.mark.parametrize("gap_left", [True, False])
def test_a_small_model_is_an_expression(spark, gap_left):
    own, gaps = np.array([1, 1, 2, 3, 4]), np.array([gap_left, not gap_left, True, True, True])
    tree = Tree(
        np.array([0, 1, 0, 0, 0]), np.array([1, 2, 0, 0, 0]), gaps, own, np.array([2, 3, 2, 3, 4]),
        np.array([0.0, 0.0, 0.25, -0.5, 0.125]), np.zeros(5), 2,
    )
    tree = tree._replace(
        left=np.array([1, 3, 2, 3, 4]), right=np.array([2, 4, 2, 3, 4])
    )
    model = Model(["x", "y"], [np.array([0.5, 1.5]), np.array([2.0])], 0.3, [tree, tree])
    values = [None, float("nan"), float("-inf"), -0.0, 0.5, 1.0, 1.5, 2.0, 9.0, float("inf")]
    df = spark.createDataFrame(
        [(i * 10 + j, x, y) for i, x in enumerate(values) for j, y in enumerate(values)],
        "id int, x double, y double",
    )
    small = boosting.predict(df, model, ["id"])
    assert "EvalPython" not in small._jdf.queryExecution().executedPlan().toString()
    every = boosting.predict_all(df, [model], ["id"])
    assert {r.id: r.prediction for r in small.collect()} == {
        r.id: r.predictions[0] for r in every.collect()
    }
