"""Bounds on joined rows against the exact audit, and folds of equal size."""

import random

import pytest

from sharewise.operators import folds, metadata


def tables_of(spark, rng, keys, pairs):
    names = [f"o/p{rng.randrange(keys)}" for _ in range(3 * keys)]
    dim = spark.createDataFrame([(n,) for n in [*names, None, None]], "project_id string")
    ends = [(i, *(rng.choice([None, "lost", f"o/p{rng.randrange(keys)}"]) for _ in "ab")) for i in range(pairs)]
    return spark.createDataFrame(ends, "id bigint, project_a string, project_b string"), dim


@pytest.mark.parametrize("width", [1, 4, 64, 4096])
def test_bound_is_never_below_the_audit(spark, width):
    rng = random.Random(width)
    pairs, dim = tables_of(spark, rng, 40, 300)
    exact = metadata.fanout_audit(pairs, dim).first()
    bound = metadata.fanout_forecast(pairs, dim, width=width).first()
    assert bound.rows_before == exact.rows_before == 300
    assert bound.most_after_a >= exact.rows_after_a and bound.most_after_b >= exact.rows_after_b
    if width == 4096:
        assert (bound.most_after_a, bound.most_after_b) == (exact.rows_after_a, exact.rows_after_b)


def test_no_pairs_and_no_dimension(spark):
    pairs, dim = tables_of(spark, random.Random(1), 5, 10)
    assert tuple(metadata.fanout_forecast(pairs.filter("false"), dim, 8).first()) == (0, 0, 0)
    assert tuple(metadata.fanout_forecast(pairs, dim.filter("false"), 8).first()) == (10, 10, 10)


def test_join_over_the_limit_is_stopped(spark):
    pairs, dim = tables_of(spark, random.Random(2), 10, 50)
    with pytest.raises(metadata.Fanout):
        metadata.check_fanout(pairs, dim, 1.5)
    metadata.check_fanout(pairs, dim.dropDuplicates(), 1.0)


@pytest.mark.parametrize(("n", "k"), [(0, 5), (3, 5), (100, 5), (101, 7)])
def test_folds_differ_by_one_at_most(spark, n, k):
    rows = [(i, side) for i in range(n) for side in "ab"] + [(None, "a")]
    df = spark.createDataFrame(rows, "id bigint, project_a string").repartition(6)
    found = folds.assign_equal_folds(df, k).collect()
    assert len(found) == len(rows) and [r.fold for r in found if r.id is None] == [None]
    by_id = {}
    for r in found:
        by_id.setdefault(r.id, set()).add(r.fold)
    assert all(len(v) == 1 for v in by_id.values())  # a pair and its mirror stay together
    sizes = [sum(v == {f} for v in by_id.values()) for f in range(k)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_ranks_do_not_hang_on_how_rows_lie(spark):
    ids = spark.range(500)
    one = {r.id: r["rank"] for r in folds.permutation_ranks(ids.repartition(7)).collect()}
    assert sorted(one.values()) == list(range(500))
    assert one == {r.id: r["rank"] for r in folds.permutation_ranks(ids.coalesce(1)).collect()}
    other = {r.id: r["rank"] for r in folds.permutation_ranks(ids, seed=7).collect()}
    assert other != one and sorted(other.values()) == list(range(500))
