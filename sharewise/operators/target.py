"""Mean weight of a project as a feature, from other rows than the one it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.functions import ratio
from sharewise.operators.joins import counts_for, lookup_join, side_counts
from sharewise.operators.pairs import mirror, mirror_sides

SINGLETONS = ("own", "global_mean")


def project_stats(train: DataFrame, side: str) -> DataFrame:
    """Sum, count and mean of the non-null weights, and all rows, per project of one side.

    Combined on the map side, so a hub project costs one row per task.
    """
    weight = f"weight_{side}"
    return train.groupBy(f"project_{side}").agg(
        F.sum(weight).alias("weight_sum"),
        F.count(weight).alias("weight_count"),
        F.avg(weight).alias("weight_mean"),
        F.count(F.lit(1)).alias("__n"),
    )


def global_mean(train: DataFrame):
    """Mean of ``weight_a``, as a scalar subquery. It fills gaps on both sides."""
    return train.agg(F.avg("weight_a").alias("mean")).scalar()


def _loo_weight(side: str, singleton: str):
    weight = F.col(f"weight_{side}")
    others = (F.col("weight_sum") - weight) / (F.col("weight_count") - 1)
    alone = weight if singleton == "own" else F.lit(None).cast("double")
    return F.when(F.col("weight_count") > 1, others).otherwise(alone)


def _with_stats(df: DataFrame, side: str, stats: DataFrame) -> DataFrame:
    """Rows with their project's sums. The sums know the rows per key, so hub projects are
    found without another pass."""
    key = f"project_{side}"
    sums = stats.select(key, "weight_sum", "weight_count")
    return lookup_join(df, sums, key, ["id"], counts=stats)


def holdout_encoding(df: DataFrame, train: DataFrame) -> DataFrame:
    """Project means of ``train`` on the rows of ``df``; unseen projects get the global mean."""
    out, counts = df, side_counts(df)  # counted before any join, so no join is run twice
    for side in ("a", "b"):
        key, name = f"project_{side}", f"project_mean_weight_{side}"
        means = project_stats(train, side).select(key, F.col("weight_mean").alias(name))
        out = lookup_join(out, means, key, ["id"], counts=counts_for(counts, key))
        out = out.withColumn(name, F.coalesce(name, global_mean(train)))
    return out


def leave_one_out_encoding(
    df: DataFrame, singleton: str = "own", mirrored: bool = False
) -> DataFrame:
    """Mean weight of the project's other rows. One row in, one row out.

    A project with a single weight keeps its own value, which gives away the label;
    ``singleton='global_mean'`` avoids that. Rows whose weight is null get the global mean.
    With ``mirrored`` the rows are those of ``mirror(df)``, where both sides have the same sums:
    they are made once, and a pair looks them up once.
    """
    if singleton not in SINGLETONS:
        raise ValueError(f"singleton must be one of {SINGLETONS}")
    out, whole = df, mirror(df) if mirrored else df
    for side in ("a", "b"):
        name = f"project_mean_weight_{side}"
        value = _loo_weight(side, singleton)
        value = F.when(F.col(f"project_{side}").isNotNull(), value)
        out = (
            _with_stats(out, side, _stats_of(whole, side, mirrored))
            .withColumn(name, F.coalesce(value, global_mean(whole)))
            .drop("weight_sum", "weight_count")
        )
    return mirror_sides(out) if mirrored else out


def _stats_of(df: DataFrame, side: str, mirrored: bool) -> DataFrame:
    """``project_stats``; those of side a for either side of mirrored rows."""
    if mirrored:
        return project_stats(df, "a").withColumnRenamed("project_a", f"project_{side}")
    return project_stats(df, side)


def target_encoding(
    df: DataFrame,
    train: DataFrame | None = None,
    singleton: str = "own",
    mirrored: bool = False,
) -> DataFrame:
    """Hold-out encoding when ``train`` is given, leave-one-out within ``df``, or with
    ``mirrored`` within ``mirror(df)``, otherwise."""
    if train is not None:
        return holdout_encoding(df, train)
    return leave_one_out_encoding(df, singleton, mirrored)


def leave_one_out_values(df: DataFrame, side: str) -> DataFrame:
    """The distinct ``(project, mean_weight)`` pairs behind the leave-one-out encoding."""
    rows = df.select("id", f"project_{side}", f"weight_{side}")
    return (
        _with_stats(rows, side, project_stats(rows, side))
        .select(
            F.col(f"project_{side}").alias("project"),
            _loo_weight(side, "own").alias("mean_weight"),
        )
        .distinct()
    )


def expansion_audit(df: DataFrame, side: str) -> DataFrame:
    """Per project: rows, distinct encodings, and the rows a join on the project alone gives.

    Joining the distinct values back by project pairs every row with every value of its
    project. That product is counted here, not emitted: it is quadratic in a hub project.
    """
    values = leave_one_out_values(df, side).groupBy("project")
    values = values.agg(F.count(F.lit(1)).alias("distinct_values"))
    rows = df.groupBy(F.col(f"project_{side}").alias("project"))
    rows = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(values, "project", "left").select(
        "project",
        "n_rows",
        "distinct_values",
        (F.col("n_rows") * F.coalesce("distinct_values", F.lit(1))).alias("expanded_rows"),
    )


def expanded_stats(df: DataFrame, side: str) -> DataFrame:
    """Per project, over the expanded form in which each of its rows meets each distinct value:
    ``expanded_rows`` and the sums of weights, of values, and of the squares and products.

    A sum over a product of two lists is a product of sums over each, so the rows and the values
    of a project stay apart: one row a project on either side, and the product is never made.
    A project without a value keeps its rows, as in a left join.
    """
    weight, value = F.col(f"weight_{side}"), F.col("mean_weight")
    rows = df.groupBy(F.col(f"project_{side}").alias("project")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(weight).alias("n_w"),
        F.sum(weight).alias("w"),
        F.sum(weight * weight).alias("ww"),
    )
    values = leave_one_out_values(df, side).groupBy("project").agg(
        F.count(F.lit(1)).alias("k"),
        F.count(value).alias("k_v"),
        F.sum(value).alias("v"),
        F.sum(value * value).alias("vv"),
    )
    times = F.coalesce("k", F.lit(1))
    return rows.join(values, "project", "left").select(
        "project",
        (F.col("n") * times).alias("expanded_rows"),
        (F.col("w") * times).alias("sum_weight"),
        (F.col("ww") * times).alias("sum_weight_squared"),
        (F.col("v") * F.col("n")).alias("sum_value"),
        (F.col("vv") * F.col("n")).alias("sum_value_squared"),
        (F.col("w") * F.col("v")).alias("sum_product"),
        (F.col("n_w") * F.coalesce("k_v", F.lit(0))).alias("n_both"),
    )


def expanded_summary(df: DataFrame, side: str) -> DataFrame:
    """One row over all projects: size of the expanded form, means of weight and value in it, and
    their correlation; the row weights of the expansion are all in ``expanded_stats``."""
    names = ("weight", "value")
    sums = expanded_stats(df, side).agg(
        F.sum("expanded_rows").alias("expanded_rows"),
        F.sum("n_both").alias("n"),
        *[F.sum(f"sum_{c}").alias(c) for c in names],
        *[F.sum(f"sum_{c}_squared").alias(f"{c}_squared") for c in names],
        F.sum("sum_product").alias("product"),
    )

    def spread(c: str) -> Column:
        return F.col(f"{c}_squared") / F.col("n") - F.pow(F.col(c) / F.col("n"), F.lit(2))

    joint = F.col("product") / F.col("n") - F.col("weight") * F.col("value") / F.pow("n", F.lit(2))
    scale = F.sqrt(F.greatest(spread("weight") * spread("value"), F.lit(0.0)))
    return sums.select(
        "expanded_rows",
        ratio(F.col("weight"), F.col("n")).alias("mean_weight"),
        ratio(F.col("value"), F.col("n")).alias("mean_value"),
        (joint / F.nullif(scale, F.lit(0.0))).alias("correlation"),
    )
