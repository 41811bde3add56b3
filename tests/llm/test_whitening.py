"""Whitening against dense numpy over all rows, and in odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharewise.llm import queries, whitening
from sharewise.operators import joins

NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id bigint, embedding array<float>"


def dense(rows, components=32, weights="counts"):
    """What the contract says, from one matrix in memory."""
    kept = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 10**6 for c in v] for _, v in kept])
    fitted = x if weights == "counts" else np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    z = (x - sums / n) @ vectors / np.sqrt(values)
    off = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return kept, n, off, z, values / np.trace(cov)


def compare(found, rows, **how):
    kept, n, off, z, share = dense(rows, **how)
    width = z.shape[1]
    assert len(found) == len(kept) * width
    by_key = {}
    for r in found:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    signs = np.zeros(width)
    for (key, _), deviation, line in zip(kept, off, z, strict=True):
        got = by_key[key]
        assert sorted(got) == list(range(1, width + 1))
        assert {r.n for r in got.values()} == {n} and {r.deviation for r in got.values()} == {deviation}
        values = np.array([got[i + 1].whitened for i in range(width)])
        first = (signs == 0) & (np.abs(line) > 0.1)
        signs[first] = np.sign(values * line)[first]
        np.testing.assert_allclose(values, line * np.where(signs, signs, np.sign(values * line)), atol=1e-6)
        np.testing.assert_allclose([got[i + 1].explained for i in range(width)], share, rtol=1e-6)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


def vectors(seed, n, width, copies=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, (1 + j) / 8) for j in range(width)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_like_a_dense_matrix(spark, weights, monkeypatch):
    rows = vectors(1, 60, 6, copies=200)  # one vector makes up most rows
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [NAN] * 6), (903, [INF] * 6), (904, [])]
    df = spark.createDataFrame(rows + odd, SHAPE)
    df = df.withColumns({c: F.lit("x") for c in ("key", "x", "copies", "z", "n", "deviation")})
    found = whitening.whiten(df, weights=weights).collect()
    compare(found, rows + odd, weights=weights)
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 7)
    again = whitening.whiten(df, weights=weights).collect()
    assert len(again) == len(found)
    compare(again, rows + odd, weights=weights)


def test_fewer_components_and_repeated_rows(spark):
    rows = vectors(2, 40, 5)
    df = spark.createDataFrame(rows + rows[:3] + [(None, rows[4][1])], SHAPE)
    found = whitening.whiten(df, components=2)
    assert found.count() == 2 * 44
    assert found.filter("vec_id is null").count() == 2
    assert {r.c for r in found.filter("vec_id < 3").groupBy("vec_id").agg(F.count("*").alias("c")).collect()} == {4}


def test_no_variance_no_row(spark):
    one = [0.5, -0.5]
    for rows in ([], [(1, None)], [(1, one)], [(i, one) for i in range(5)], [(1, []), (2, [])]):
        df = spark.createDataFrame(rows, SHAPE)
        found = whitening.whiten(df)
        assert found.collect() == []
        assert found.columns == [
            "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
        ]


def test_dependent_entries_have_fewer_components(spark):
    rows = [(i, [float(a), float(2 * a), float(b)]) for i, (a, b) in enumerate(vectors_of_two(30))]
    found = whitening.whiten(spark.createDataFrame(rows, SHAPE)).collect()
    assert {r.component for r in found} == {1, 2} and found[0].identity_error < 1e-8


def vectors_of_two(n):
    rng = random.Random(3)
    return [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]


def test_other_widths_and_numbers_too_large_are_left_out(spark):
    rows = vectors(4, 20, 3)
    odd = [(100, [1.0, 2.0]), (101, [1.0] * 4), (102, [1e30, 0.0, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows + odd, SHAPE)).collect()
    compare(found, rows)


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening.deviations(x, 1, np.zeros(2, np.int64)) == [None, 25]


def test_query_like_a_dense_matrix(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.embedding_whitening(spark, sf).collect(), rows)
