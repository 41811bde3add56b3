import random

import pytest
from pyspark.sql import functions as F

from sharewise.operators.joins import (
    MAX_HOT_KEYS,
    fits_broadcast,
    hot_keys,
    key_counts,
    lookup_join,
    salted_join,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a third without a key, and exact copies."""
    rng = random.Random(1)
    rows = [(i, "hub") for i in range(300)] + [(i, None) for i in range(300, 600)]
    rows += [(i, f"p{rng.randrange(40)}") for i in range(600, 900)] + [(1, "hub")] * 50
    return spark.createDataFrame(rows, "id long, k string").repartition(5)


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [("hub", 1), ("hub", 2), (None, 9)] + [(f"p{i}", i) for i in range(0, 60, 2)]
    return spark.createDataFrame(rows, "k string, v int")


def rows_of(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salting_changes_no_row(skewed, lookup, how):
    plain = skewed.join(lookup, "k", how).select("id", "k", "v")
    salted = salted_join(skewed, lookup, "k", ["id"], how, rows_per_task=20)
    assert salted.columns == ["id", "k", "v"]
    assert rows_of(salted) == rows_of(plain)
    assert rows_of(lookup_join(skewed, lookup, "k", ["id"], how)) == rows_of(plain)


def test_a_hub_is_cut_into_task_loads(skewed):
    hot = {r[0]: r[1] for r in hot_keys(key_counts(skewed, "k"), "k", 20).collect()}
    assert hot["hub"] == 18 and hot[None] == 15
    assert len(hot) < MAX_HOT_KEYS


def test_hub_rows_spread_over_partitions(spark, skewed, lookup):
    """No task of the shuffled join keeps more than a small part of the hub's rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = salted_join(skewed, lookup, "k", ["id"], rows_per_task=20)
        sizes = out.filter("k = 'hub'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1


def test_size_check_follows_the_broadcast_limit(spark):
    small, large = spark.range(1000), spark.range(100_000_000)
    assert fits_broadcast(small) and not fits_broadcast(large)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not fits_broadcast(small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
