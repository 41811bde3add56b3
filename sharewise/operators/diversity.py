"""Error diversity: how far a model's errors run along with a base model's.

Frames carry ``weight_a`` (label), ``prediction`` and ``base_prediction``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.functions import error_correlation, mse

# Floor added to a deviation, step of the finite difference.
DEVIATION_FLOOR = 1e-8
HESSIAN_STEP = 1e-3

HESSIANS = ("squared", "finite_difference")


def diversity_metric(df: DataFrame, label: str = "weight_a") -> DataFrame:
    """One row: ``mse`` and ``error_corr``, in one pass."""
    y, p, b = F.col(label), F.col("prediction"), F.col("base_prediction")
    return df.agg(mse(y, p).alias("mse"), error_correlation(y, p, b).alias("error_corr"))


def error_moments(df: DataFrame, label: str = "weight_a") -> DataFrame:
    """Everything the gradient needs to know about all rows: one row, one pass.

    With errors e and b of the two models: count, means, sample deviations and the mean
    product of the standardised errors.
    """
    e, b = F.col("prediction") - F.col(label), F.col("base_prediction") - F.col(label)
    raw = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(e).alias("e_mean"),
        F.avg(b).alias("b_mean"),
        F.stddev_samp(e).alias("e_sd"),
        F.stddev_samp(b).alias("b_sd"),
        F.covar_pop(e, b).alias("eb"),
    )
    spread = (F.col("e_sd") + DEVIATION_FLOOR) * (F.col("b_sd") + DEVIATION_FLOOR)
    return raw.withColumn("rho", F.col("eb") / spread)


def diversity_gradient(
    df: DataFrame,
    alpha: float = 0.1,
    label: str = "weight_a",
    hessian: str = "squared",
) -> DataFrame:
    """Add ``grad`` and ``hess`` of mean squared error + alpha * error correlation.

    The correlation term depends on all rows only through ``error_moments``, so a round is one
    aggregate and one projection; its gradient at a row is

        alpha / (n (sd + floor)) * (z_base - n rho (e - mean e) / ((n - 1) sd))

    ``hessian='squared'`` is that of the squared error, 2/n. ``'finite_difference'`` is
    that between the loss at a shifted prediction, there with the opposite sign of alpha, and
    the loss here; a shift leaves standardised errors as they are, so it comes to
    2/n - 2 * (correlation term) / step and may be negative.
    """
    if hessian not in HESSIANS:
        raise ValueError(f"hessian must be one of {HESSIANS}")
    moments = error_moments(df, label)
    m = moments.select(F.struct(*moments.columns)).scalar()
    e, b = F.col("prediction") - F.col(label), F.col("base_prediction") - F.col(label)
    n, sd = m["n"], m["e_sd"]
    z_base = (b - m["b_mean"]) / (m["b_sd"] + DEVIATION_FLOOR)
    centred = F.when(sd == 0, F.lit(0.0)).otherwise(
        n * m["rho"] * (e - m["e_mean"]) / ((n - 1) * F.when(sd != 0, sd))
    )
    pull = F.lit(float(alpha)) / (n * (sd + DEVIATION_FLOOR)) * (z_base - centred)
    curve = F.lit(2.0) / n
    if hessian == "finite_difference":
        curve = curve - 2.0 * F.col("__pull") / HESSIAN_STEP
    return (
        df.withColumn("__pull", pull)
        .withColumns({"grad": F.lit(2.0) * e / n + F.col("__pull"), "hess": curve})
        .drop("__pull")
    )
