"""Cross-validation folds and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.functions import mse, ratio
from sharewise.operators.joins import lookup_join
from sharewise.session import stage

# Number of folds and their seed.
FOLDS = 5
SEED = 42

ROW_KEY = ("id", "project_a", "project_b")


def fold_of(keys: Sequence[str], k: int = FOLDS, seed: int = SEED) -> Column:
    """Fold number of a row from a digest of its keys: no sort, no shuffle, and the same in
    every run and engine. Sizes are equal only on average."""
    digest = F.md5(F.concat_ws(":", *keys, F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int")


def assign_folds(
    df: DataFrame, by: str = "id", k: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold``. ``by='id'`` keeps a pair and its mirror in one fold; ``by='row'`` splits
    rows one by one, which lets a mirror leak its twin's label."""
    if by not in ("id", "row"):
        raise ValueError("by must be 'id' or 'row'")
    keys = ("id",) if by == "id" else ROW_KEY
    return df.withColumn("fold", fold_of(keys, k, seed))


def places(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``rank``, the place of each row in the order of ``by``, from 0.

    Rows are dealt to tasks by ranges of ``by`` and sorted there; a place is that within
    the task plus the sizes of the tasks before it, one number a task. No task sorts them all.
    """
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.select(*df.columns, F.spark_partition_id().alias("task"), inside.alias("inside"))
    placed = stage(placed, "places")  # tasks and places are fixed from here on
    sizes = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("task", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "task").select(
        *df.columns, (F.col("before") + F.col("inside")).alias("rank")
    )


def permutation_ranks(ids: DataFrame, seed: int = SEED) -> DataFrame:
    """``id, rank``: the place of each distinct id in a seeded pseudo-random order, from 0."""
    digest = F.md5(F.concat_ws(":", "id", F.lit(str(seed))))
    coded = ids.select("id").distinct().select("id", digest.alias("digest"))
    return places(coded, "digest", "id").drop("digest")


def assign_equal_folds(df: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` by dealing out ids in a seeded random order, so that folds differ by one id
    at most. A pair and its mirror share an id and stay together; a null id has no fold."""
    ranks = permutation_ranks(df.filter("id is not null"), seed)
    folds = ranks.select("id", (F.col("rank") % k).cast("int").alias("fold"))
    return lookup_join(df, folds, "id", ["id"])


def fold_scores(predictions: DataFrame, label: str = "weight_a") -> DataFrame:
    """``(fold, n_rows, mse)`` of out-of-fold predictions."""
    return predictions.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"),
        mse(F.col(label), F.col("prediction")).alias("mse"),
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold errors."""
    return scores.agg(F.avg("mse").alias("mean_mse"), F.stddev_pop("mse").alias("std_mse"))


def mean_baseline(df: DataFrame, label: str = "weight_a") -> DataFrame:
    """Predict for each fold the label mean of the other folds.

    Fold sums are one row per fold, so they come back as a scalar array, not by a join.
    """
    sums = df.groupBy("fold").agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    means = sums.agg(
        F.sum("s").alias("s"),
        F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("own"),
    )
    total = means.select(F.struct("s", "n", "own")).scalar()
    own = F.element_at(total["own"], F.col("fold"))
    return df.withColumn("prediction", ratio(total["s"] - own["s"], total["n"] - own["n"]))
