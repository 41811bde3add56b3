"""Key lookups that stay balanced when one key holds a large part of the fact rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than a task's load and more than 1/MAX_HOT_KEYS of the rows,
# so there are fewer than MAX_HOT_KEYS hot keys whatever the data: that is what bounds the
# broadcast below (some 60 MB). Up to 2e12 rows every key above a task's load is split.
MAX_HOT_KEYS = 1_000_000
ROWS_PER_TASK = 2_000_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size estimate lets it broadcast ``df`` unasked, and the estimate holds:
    Catalyst counts one row for all that an explode makes of one."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return taken_for_small(df, rows_made(plan))


def taken_for_small(df: DataFrame, times: float = 1) -> bool:
    """Whether ``times`` Catalyst's size estimate is under the broadcast limit."""
    session = df.sparkSession._jsparkSession.sessionState()
    limit = session.conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size <= limit / times


def rows_made(plan) -> float:
    """Rows that the explodes of a logical plan make of one; infinite if the plan has an array
    whose length is not known before it runs."""
    made = 1.0
    if plan.nodeName() == "Generate":
        source = plan.generator().children().head()
        if source.prettyName() == "array":
            made = source.children().size()
        elif source.nodeName() == "Literal" and source.dataType().typeName() == "array":
            made = source.value().numElements() if source.value() is not None else 1
        else:
            made = math.inf
    below = plan.children()
    return math.prod((rows_made(below.apply(i)) for i in range(below.size())), start=max(made, 1))


def key_counts(facts: DataFrame, key: str) -> DataFrame:
    """Rows per key; combined on the map side, so a hot key costs one row per task."""
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))


def side_counts(pairs: DataFrame, name=F.col) -> DataFrame:
    """Rows per project over both sides (``__key``, ``__n``), in one pass for the lookups of both:
    no less than either side holds, so no key is cut more coarsely."""
    sides = F.array(name("project_a"), name("project_b"))
    return key_counts(pairs.select(F.explode(sides).alias("__key")), "__key")


def counts_for(counts: DataFrame, key: str) -> DataFrame:
    """``side_counts`` under the name of one side's key."""
    return counts.withColumnRenamed("__key", key)


def hot_keys(counts: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """``(__hot_key, __copies)`` for the fewer than MAX_HOT_KEYS keys worth splitting."""
    rows_per_task = rows_per_task or ROWS_PER_TASK
    total = counts.agg(F.sum("__n").alias("total")).scalar()
    return counts.filter(
        (F.col("__n") > rows_per_task) & (F.col("__n") * MAX_HOT_KEYS > total)
    ).select(
        F.col(key).alias("__hot_key"),
        F.ceil(F.col("__n") / rows_per_task).alias("__copies"),
    )


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_task: int | None = None,
    shuffled: bool = False,
) -> DataFrame:
    """Join on ``key`` with each hot key cut into as many shares as it has task-loads of rows.

    Fact rows of a hot key draw a share from a hash of ``spread_by`` and of the partition they
    lie in (so equal rows of different partitions part too; a retried task draws the same
    shares again). Lookup rows of a hot key are repeated once per share. Null keys never
    match, but a crowd of them is spread the same way.

    Where no key is hot, adaptive execution drops the shares and sizes both sides anew. So a table
    that Catalyst takes for smaller than it is needs ``shuffled``: then neither side is broadcast.
    """
    counts = key_counts(facts, key) if counts is None else counts.select(key, "__n")
    hot = F.broadcast(hot_keys(counts, key, rows_per_task))
    share = F.pmod(F.xxhash64(*spread_by, F.spark_partition_id()), F.col("__copies"))
    left = (
        facts.join(hot, F.col(key).eqNullSafe(F.col("__hot_key")), "left")
        .withColumn("__salt", F.coalesce(share, F.lit(0).cast("long")))
        .drop("__hot_key", "__copies")
    )
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1)) - 1)
    right = (
        lookup.join(hot, F.col(key).eqNullSafe(F.col("__hot_key")), "left")  # one broadcast for both
        .withColumn("__salt", F.explode(copies))
        .drop("__hot_key", "__copies")
    )
    extra = [c for c in lookup.columns if c != key]
    right = right.hint("merge") if shuffled else right
    return left.join(right, [key, "__salt"], how).select(*facts.columns, *extra)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Attach ``lookup`` to ``facts`` by ``key``.

    A lookup whose estimated size is under the broadcast limit is left to Catalyst, which then
    moves no fact row. A larger one is shuffled, with the hot keys of the facts split, and so is
    one that only passes for small because its rows were exploded.
    ``counts`` (key, ``__n``) saves counting the facts; it need not be exact, for it only
    decides how finely a key is split, never which rows match.
    """
    if fits_broadcast(lookup):
        extra = [c for c in lookup.columns if c != key]
        return facts.join(lookup, key, how).select(*facts.columns, *extra)
    shuffled = taken_for_small(lookup)
    return salted_join(facts, lookup, key, spread_by, how, counts, shuffled=shuffled)
