from collections import Counter

import pytest

from sharewise import schemas
from sharewise.operators.metadata import (
    attach_metadata,
    fanout_audit,
    missing_metadata,
    project_dimension,
)
from sharewise.operators.pairs import mirror, project_universe, strip_urls


def record(name, **over):
    values = dict.fromkeys(schemas.REPO_METADATA.fieldNames())
    values |= {"full_name": name, "stargazers_count": 10, "homepage": None} | over
    return tuple(values[f] for f in schemas.REPO_METADATA.fieldNames())


@pytest.fixture(scope="module")
def metadata(spark):
    rows = [
        record("Foo/Bar", homepage=""),
        record("a/b", stargazers_count=3, homepage="http://x"),
        record("dup/dup", stargazers_count=1),
        record("dup/dup", stargazers_count=2),
    ]
    return spark.createDataFrame(rows, schemas.REPO_METADATA)


def test_mirror_doubles_and_keeps_ids_and_duplicates(pair_frame):
    rows = [(1, "a", "b", 0.25, 0.75), (1, "a", "b", 0.25, 0.75), (2, None, "c", None, 1.0)]
    once = mirror(pair_frame(rows))
    swapped = [(i, b, a, wb, wa) for i, a, b, wa, wb in rows]
    assert Counter(map(tuple, once.collect())) == Counter(rows + swapped)
    twice = Counter(map(tuple, mirror(once).collect()))
    assert twice == Counter((rows + swapped) * 2)


def test_universe_is_distinct_over_all_sides(pair_frame):
    train = strip_urls(pair_frame([(1, "https://github.com/a/b", "c/d", 0.5, 0.5)]))
    test = pair_frame([(2, "a/b", "E/F", None, None)])
    got = sorted(r.project for r in project_universe(train, test).collect())
    assert got == ["E/F", "a/b", "c/d"]


def test_empty_homepage_counts_as_one(metadata):
    flags = {r.project_id: r.has_homepage for r in project_dimension(metadata).collect()}
    assert flags == {"foo/bar": True, "a/b": True, "dup/dup": False}


def test_case_is_folded_on_the_key_side_only(pair_frame, metadata):
    pairs = pair_frame([(1, "Foo/Bar", "a/b", 0.5, 0.5), (2, None, "A/B", 0.5, 0.5)])
    dim = project_dimension(metadata)
    stars = {
        r.id: (r.stars, r.stars_b) for r in attach_metadata(pairs, dim).collect()
    }
    assert stars == {1: (None, 3), 2: (None, None)}
    folded = attach_metadata(pairs, dim, fold_case=True)
    assert {r.id: (r.stars, r.stars_b) for r in folded.collect()} == {
        1: (10, 3), 2: (None, 3),
    }
    assert folded.columns == attach_metadata(pairs, dim).columns


def test_fanout_is_found_without_fanning_out(pair_frame, metadata):
    pairs = pair_frame(
        [(1, "dup/dup", "dup/dup", 0.5, 0.5), (2, "a/b", "dup/dup", 0.5, 0.5),
         (3, "dup/dup", "none", 0.5, 0.5)]
    )
    dim = project_dimension(metadata)
    audit = fanout_audit(pairs, dim).first()
    assert (audit.rows_before, audit.rows_after_a) == (3, 5)
    assert audit.rows_after_b == attach_metadata(pairs, dim).count() == 8
    assert (audit.unmatched_a, audit.unmatched_b) == (0, 1)


def test_missing_metadata(spark, metadata):
    asked = spark.createDataFrame([("a/b",), ("Foo/Bar",), ("x/y",)], "project string")
    left = missing_metadata(asked, project_dimension(metadata)).collect()
    assert sorted(r.project for r in left) == ["Foo/Bar", "x/y"]
