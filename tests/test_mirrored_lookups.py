"""Lookups made once per pair give the rows of lookups made on mirrored pairs."""

from collections import Counter

import pytest

from sharewise import schemas
from sharewise.operators.features import temporal_features
from sharewise.operators.metadata import attach_metadata, fanout_audit, project_dimension
from sharewise.operators.pairs import mirror
from sharewise.operators.target import target_encoding
from sharewise.plans.features import pair_features

AS_OF = "2002-01-01 12:00:00"


@pytest.fixture(scope="module")
def pairs(pair_frame):
    return pair_frame([
        (1, "a/b", "dup/dup", 0.25, 0.75), (1, "a/b", "dup/dup", 0.25, 0.75),
        (2, None, "a/b", None, 1.0), (3, "none", "dup/dup", 0.5, 0.5), (4, "a/b", "c/d", 0.125, None),
    ])


@pytest.fixture(scope="module")
def dimension(spark):
    def record(name, created, stars):
        values = dict.fromkeys(schemas.REPO_METADATA.fieldNames())
        values |= {"full_name": name, "created_at": created, "updated_at": "2001-01-01T00:00:00Z"}
        values["stargazers_count"] = stars
        return tuple(values.values())

    rows = [record("a/b", "1999-05-01T10:00:00Z", 3), record("dup/dup", "2000-02-29T00:00:00Z", 1),
            record("dup/dup", None, 2), record("not/asked", "no date", 9)]
    return project_dimension(spark.createDataFrame(rows, schemas.REPO_METADATA))


def rows_of(df):
    return Counter(map(str, df.collect()))


def test_metadata_and_features(pairs, dimension):
    once = attach_metadata(pairs, dimension, mirrored=True)
    assert rows_of(once) == rows_of(attach_metadata(mirror(pairs), dimension))
    names = ["id", "created_dt", "age_days", "age_days_b", "stars_ratio", "stars_decay_b_0_001"]
    once = pair_features(pairs, dimension, AS_OF, mirrored=True).select(*names)
    assert rows_of(once) == rows_of(pair_features(mirror(pairs), dimension, AS_OF).select(*names))


def test_dates_parsed_with_the_dimension(pairs, dimension):
    plain = temporal_features(attach_metadata(pairs, dimension), AS_OF)
    early = pair_features(pairs, dimension, AS_OF)
    names = ["id", "created_dt", "updated_dt_b", "days_since_update", "age_days_b"]
    assert rows_of(early.select(*names)) == rows_of(plain.select(*names))
    assert not [c for c in early.columns if "_bad" in c]


def test_audit(pairs, dimension):
    assert fanout_audit(pairs, dimension, mirrored=True).first() == fanout_audit(mirror(pairs), dimension).first()


@pytest.mark.parametrize("singleton", ["own", "global_mean"])
def test_encoding(pairs, singleton):
    once = target_encoding(pairs, singleton=singleton, mirrored=True)
    assert rows_of(once) == rows_of(target_encoding(mirror(pairs), singleton=singleton))
