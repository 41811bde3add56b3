import random

import pytest

from sharewise.operators import target
from sharewise.operators.target import (
    expansion_audit,
    leave_one_out_values,
    target_encoding,
)

ROWS = [
    (1, "p", "x", 0.2, 0.8),
    (2, "p", "y", 0.4, 0.6),
    (3, "p", "z", 0.9, 0.1),
    (4, "q", "x", 0.7, 0.3),
    (5, "r", "x", None, None),
    (6, "r", "y", 0.5, 0.5),
    (7, None, "y", 0.3, 0.7),
]
GLOBAL = sum(r[3] for r in ROWS if r[3] is not None) / 6


def encoded(df, **options):
    return {r.id: r for r in target_encoding(df, **options).collect()}


def test_leave_one_out(pair_frame):
    got = encoded(pair_frame(ROWS))
    assert len(got) == len(ROWS)
    a = {i: r.project_mean_weight_a for i, r in got.items()}
    assert a[1] == pytest.approx(0.65) and a[2] == pytest.approx(0.55)
    assert a[3] == pytest.approx(0.3)
    assert a[4] == 0.7  # alone: its own weight
    assert a[5] == pytest.approx(GLOBAL)  # no weight of its own
    assert a[6] == 0.5  # the only weight of its project
    assert a[7] == pytest.approx(GLOBAL)  # no project
    assert got[2].project_mean_weight_b == pytest.approx((0.5 + 0.7) / 2)


def test_singleton_without_its_own_label(pair_frame):
    got = encoded(pair_frame(ROWS), singleton="global_mean")
    assert got[4].project_mean_weight_a == pytest.approx(GLOBAL)
    assert got[1].project_mean_weight_a == pytest.approx(0.65)


def test_hold_out_uses_the_mean_of_side_a_for_both_gaps(pair_frame):
    train = pair_frame(ROWS)
    new = pair_frame([(1, "p", "new", None, None), (2, "new", "x", None, None)])
    got = encoded(new, train=train)
    assert got[1].project_mean_weight_a == pytest.approx(0.5)
    assert got[1].project_mean_weight_b == pytest.approx(GLOBAL)
    assert got[2].project_mean_weight_a == pytest.approx(GLOBAL)
    assert got[2].project_mean_weight_b == pytest.approx((0.8 + 0.3) / 2)


def test_expansion_is_counted(pair_frame):
    df = pair_frame(ROWS[:4])
    audit = {r.project: tuple(r)[1:] for r in expansion_audit(df, "a").collect()}
    assert audit == {"p": (3, 3, 9), "q": (1, 1, 1)}
    values = leave_one_out_values(df, "a")
    joined = df.join(values.withColumnRenamed("project", "project_a"), "project_a", "left")
    assert joined.count() == sum(a[2] for a in audit.values())


def test_encoding_without_broadcast(spark, pair_frame):
    want = encoded(pair_frame(ROWS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert encoded(pair_frame(ROWS)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sums_over_the_expanded_form_without_making_it(pair_frame):
    rng = random.Random(4)
    rows = [(i, f"p{rng.randrange(6)}", f"q{i % 3}", rng.choice([0.25, 0.5, 0.75, None]), 0.5) for i in range(60)]
    rows.append((99, "alone", "q1", None, None))
    df = pair_frame(rows)
    values = target.leave_one_out_values(df, "a").withColumnRenamed("project", "project_a")
    product = df.join(values, "project_a", "left").collect()
    found = {r.project: r for r in target.expanded_stats(df, "a").collect()}
    assert set(found) == {r.project_a for r in product}
    for name, got in found.items():
        own = [(r.weight_a, r.mean_weight) for r in product if r.project_a == name]
        assert got.expanded_rows == len(own)
        w, v = ([x[i] for x in own if x[i] is not None] for i in (0, 1))
        if w:
            assert (got.sum_weight, got.sum_value) == (pytest.approx(sum(w)), pytest.approx(sum(v)))
            assert got.sum_weight_squared == pytest.approx(sum(x * x for x in w))
            both = [a * b for a, b in own if a is not None and b is not None]
            assert got.sum_product == pytest.approx(sum(both)) and got.n_both == len(both)
    assert target.expanded_stats(df.filter("false"), "a").count() == 0
