import itertools
import math
import random

import pytest

from sharewise.operators.consistency import (
    _closed,
    _numbered,
    edges,
    is_consistent,
    mirror_violations,
    triple_summary,
    triples,
    weight_sum_check,
)
from sharewise.operators.pairs import mirror
from sharewise.session import stage


def weighted(a, b, wa, wb, i=0):
    return (i, a, b, wa / (wa + wb), wb / (wa + wb))


def test_weight_sum(pair_frame):
    df = pair_frame([(1, "a", "b", 0.25, 0.75), (2, "a", "c", 0.5, 0.6), (3, "a", "d", None, 1.0)])
    row = weight_sum_check(df).first()
    assert (row.n_rows, row.n_violations) == (3, 2)
    assert row.max_gap == pytest.approx(0.1)


def test_a_mirrored_table_has_no_mirror_violation(pair_frame):
    rows = [(1, "a", "b", 0.25, 0.75), (1, "a", "b", 0.25, 0.75), (2, "c", "c", 0.5, 0.5)]
    assert mirror_violations(mirror(pair_frame(rows))).isEmpty()


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a", "b", 0.25, 0.75)],
        [(1, "a", "b", 0.25, 0.75), (1, "b", "a", 0.7, 0.3)],
        [(1, "a", "b", 0.25, 0.75), (1, "b", "a", None, None)],
        [(1, "a", "b", 0.25, 0.75), (2, "b", "a", 0.75, 0.25)],
    ],
)
def test_mirror_violations_are_found(pair_frame, rows):
    assert mirror_violations(pair_frame(rows)).count() >= 1


def test_consistent_and_broken_triple(pair_frame):
    good = [weighted("a", "b", 1, 2), weighted("c", "b", 4, 2), weighted("a", "c", 1, 4)]
    assert is_consistent(pair_frame(good))
    broken = [*good[:2], weighted("a", "c", 1, 5)]
    row = triples(pair_frame(broken)).first()
    assert (row.a, row.b, row.c, row.order_violation) == ("a", "b", "c", False)
    assert row.log_gap == pytest.approx(math.log(5 / 4))
    assert not is_consistent(pair_frame(broken))


def test_order_cycle_and_zero_weight(pair_frame):
    ring = [weighted("a", "b", 2, 1), weighted("b", "c", 2, 1), weighted("c", "a", 2, 1)]
    assert triples(pair_frame(ring)).first().order_violation
    zero = [weighted("a", "b", 1, 0), weighted("b", "c", 1, 2), weighted("a", "c", 1, 1)]
    row = triple_summary(pair_frame(zero)).first()
    assert (row.n_triples, row.n_undefined) == (1, 1)


def test_triples_with_a_hub_against_brute_force(pair_frame):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(14)]
    rows = [("hub", n, rng.randint(1, 3), rng.randint(1, 3)) for n in names]
    rows += [
        (x, y, rng.randint(1, 3), rng.randint(1, 3))
        for x, y in itertools.combinations(names, 2)
        if rng.random() < 0.4
    ]
    rng.shuffle(rows)
    ratio = {}
    for x, y, wx, wy in rows:
        ratio[x, y], ratio[y, x] = wx / wy, wy / wx
    want = {}
    for a, b, c in itertools.combinations(sorted([*names, "hub"]), 3):
        if {(a, b), (b, c), (a, c)} <= ratio.keys():
            gap = abs(
                math.log(ratio[c, a]) - math.log(ratio[c, b]) - math.log(ratio[b, a])
            )
            wrong = any(
                ratio[x, y] > 1 and ratio[y, z] > 1 and not ratio[x, z] > 1
                for x, y, z in itertools.permutations((a, b, c))
            )
            want[a, b, c] = (round(gap, 9), wrong)
    frame = pair_frame([weighted(x, y, wx, wy, i) for i, (x, y, wx, wy) in enumerate(rows)])
    got = {
        (r.a, r.b, r.c): (round(r.log_gap, 9), r.order_violation)
        for r in triples(mirror(frame)).collect()
    }
    assert got == want


def test_names_and_weights_do_not_travel_with_the_neighbour_lists(pair_frame, spark):
    """Numbers replace names until triples are closed; long names then cost no exchange."""
    rng, far = random.Random(3), "a-very-long-organisation-name/" * 4
    names = [f"{far}{i}" for i in range(24)]
    rows = [
        (i, a, b, w, 1 - w)
        for i, (a, b) in enumerate(itertools.combinations(names, 2))
        for w in [rng.uniform(0.1, 0.9)]
    ]
    numbered, numbers = _numbered(stage(edges(pair_frame(rows)), "edges"))
    assert dict(numbered.dtypes) == {"u": "int", "v": "int"}
    assert numbered.filter("u >= v").isEmpty() and numbered.count() == len(rows)
    assert sorted(r.number for r in numbers.collect()) == list(range(len(names)))
    assert set(_closed(numbered).columns) == {"u", "v", "w"}
    assert triples(pair_frame(rows)).count() == math.comb(len(names), 3)
