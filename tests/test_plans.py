"""What the physical plans must and must not hold."""

import random
import re

import pytest

import __spark_entry__ as entry
from sharewise.operators import joins
from sharewise.operators.metadata import attach_metadata
from sharewise.operators.pareto import pareto_front
from sharewise.operators.target import target_encoding

# Queries that write or fit when they are built, not when they are run.
EAGER = {
    "pairs_snapshot", "metadata_snapshot", "triples", "triple_check", "first_tree",
    "first_diverse_round", "train_run", "sweep_run",
}
LAZY = sorted(set(entry.oracle_sql()) - EAGER)
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "SortAggregate")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_no_sorted_aggregate(spark, smoke_dir, name):
    if name in {"top_repo", "funding_with_repo", "funding_sql"}:
        banned = BANNED[:-1]  # the arg-max over a struct sorts, on one row per repository
    else:
        banned = BANNED
    text = plan(entry.queries()[name](spark, smoke_dir))
    assert not [b for b in banned if b in text]


def read_columns(text, table):
    found = re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", text)
    return {column.split("#")[0] for columns in found for column in columns.split(",")}


def test_scans_read_only_what_is_used(spark, smoke_dir):
    text = plan(entry.queries()["log_features"](spark, smoke_dir))
    assert read_columns(text, "part") == {"p_partkey"}
    assert "l_comment" not in text and "l_tax" not in read_columns(text, "lineitem")
    text = plan(entry.queries()["gain_share"](spark, smoke_dir))
    assert read_columns(text, "part") == {"p_brand", "p_type", "p_size", "p_retailprice"}


def test_filters_reach_the_scan(spark, smoke_dir):
    text = plan(entry.queries()["funding_sql"](spark, smoke_dir))  # forks have p_size > 40
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(p_size,40\)", text)


def test_mirror_does_not_shuffle(spark, smoke_dir):
    pairs = plan(entry.src.train(spark, smoke_dir))
    mirrored = plan(entry.src.mirrored(spark, smoke_dir))
    assert mirrored.count("Exchange") == pairs.count("Exchange") == 1


@pytest.fixture
def split_hard(spark, monkeypatch):
    """No broadcast by size, and hubs cut into shares of five rows."""
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_triples_plan_starts_at_the_staged_edges(spark, smoke_dir, split_hard):
    df = entry.queries()["triple_check"](spark, smoke_dir)
    text = plan(df)
    assert "lineitem" not in text and not [b for b in BANNED if b in text]
    assert "map_from_entries" not in text and text.count("FileScan") <= 24
    split = values(df)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert split == values(entry.queries()["triple_check"](spark, smoke_dir))


@pytest.fixture(scope="module")
def hub_pairs(pair_frame):
    """A third of the pairs share one project, and a third are copies of one pair."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        a = "org/part-1" if i < 80 else f"org/part-{rng.randrange(60)}"
        w = round(rng.random(), 3)
        rows.append((i, a, f"org/part-{60 + rng.randrange(60)}", w, 1 - w))
    return pair_frame(rows + [rows[100]] * 120).repartition(6)


def values(df):
    rounded = entry.rounded(df).collect()
    return sorted(map(str, rounded))


def test_hub_lookups_are_whole(spark, smoke_dir, hub_pairs, split_hard):
    dim = entry.src.dimension(spark, smoke_dir)
    split = attach_metadata(hub_pairs, dim)
    assert "__salt" in plan(split)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = attach_metadata(hub_pairs, dim)
    assert "__salt" not in plan(plain)
    assert values(split) == values(plain)


def test_hub_encoding_is_whole(hub_pairs, split_hard):
    got = target_encoding(hub_pairs).toPandas()
    for side in ("a", "b"):
        key, weight = f"project_{side}", f"weight_{side}"
        groups = got.groupby(key)[weight]
        others = (groups.transform("sum") - got[weight]) / (groups.transform("count") - 1)
        want = others.where(groups.transform("count") > 1, got[weight])
        assert (got[f"project_mean_weight_{side}"] - want).abs().max() < 1e-9
    assert len(got) == 360


def test_crowded_error_keeps_every_survivor(spark, split_hard):
    rows = [(i, 1.0, 0.5) for i in range(300)] + [(i, i / 7, 1.0) for i in range(300, 600)]
    df = spark.createDataFrame(rows, "model int, mse double, r2 double").repartition(6)
    assert pareto_front(df).count() == 300
