import math

import numpy as np
import pytest

from sharewise.operators.diversity import (
    DEVIATION_FLOOR,
    HESSIAN_STEP,
    diversity_gradient,
    diversity_metric,
)


def loss(p, y, b, alpha):
    e, f = p - y, b - y
    z = (e - e.mean()) / (e.std(ddof=1) + DEVIATION_FLOOR)
    zb = (f - f.mean()) / (f.std(ddof=1) + DEVIATION_FLOOR)
    return np.mean(e * e) + alpha * np.mean(z * zb)


def numeric_gradient(p, y, b, alpha, h=1e-6):
    out = np.zeros_like(p)
    for i in range(len(p)):
        up, down = p.copy(), p.copy()
        up[i] += h
        down[i] -= h
        out[i] = (loss(up, y, b, alpha) - loss(down, y, b, alpha)) / (2 * h)
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    p, y, b = rng.random((3, 200))
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(p, y, b))]
    schema = "id int, prediction double, weight_a double, base_prediction double"
    return spark.createDataFrame(rows, schema), p, y, b


@pytest.mark.parametrize("alpha", [0.0, 0.001, 0.1])
def test_gradient_is_that_of_the_loss(sample, alpha):
    df, p, y, b = sample
    rows = diversity_gradient(df, alpha).orderBy("id").collect()
    want = numeric_gradient(p, y, b, alpha)
    assert np.allclose([r.grad for r in rows], want, atol=1e-8)
    assert {r.hess for r in rows} == {2.0 / 200}


def test_coded_hessian_is_the_finite_difference_with_the_sign_turned(sample):
    df, p, y, b = sample
    alpha = 0.001
    rows = diversity_gradient(df, alpha, hessian="finite_difference").orderBy("id").collect()
    here = numeric_gradient(p, y, b, alpha)
    there = numeric_gradient(p + HESSIAN_STEP, y, b, -alpha)
    assert np.allclose([r.hess for r in rows], (there - here) / HESSIAN_STEP, atol=1e-5)


def test_metric(sample):
    df, p, y, b = sample
    row = diversity_metric(df).first()
    assert row.mse == pytest.approx(np.mean((p - y) ** 2))
    assert row.error_corr == pytest.approx(np.corrcoef(p - y, b - y)[0, 1])


def test_constant_errors_have_no_correlation(spark):
    rows = [(1.0, 0.5, 0.25), (0.75, 0.25, 0.5)]
    df = spark.createDataFrame(
        rows, "prediction double, weight_a double, base_prediction double"
    )
    row = diversity_metric(df).first()
    assert math.isnan(row.error_corr) and row.mse == 0.25
    grads = [r.grad for r in diversity_gradient(df, 0.0).collect()]
    assert grads == [0.5, 0.5]
