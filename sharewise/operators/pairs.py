"""Pair tables: id clean-up, mirroring, the set of projects they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.functions import project_id


def strip_urls(pairs: DataFrame) -> DataFrame:
    """Both project columns as ids instead of URLs; letter case is left alone."""
    return pairs.withColumns(
        {side: project_id(F.col(side)) for side in ("project_a", "project_b")}
    )


def mirror(pairs: DataFrame) -> DataFrame:
    """Every pair twice, the second time with its sides swapped. Ids and duplicates stay.

    One pass: each row is unrolled in place, so an expensive input is computed once and no
    row moves.
    """
    straight = F.struct("project_a", "project_b", "weight_a", "weight_b")
    swapped = F.struct(
        F.col("project_b").alias("project_a"),
        F.col("project_a").alias("project_b"),
        F.col("weight_b").alias("weight_a"),
        F.col("weight_a").alias("weight_b"),
    )
    return pairs.select("id", F.inline(F.array(straight, swapped)))


def mirror_sides(df: DataFrame, also: dict[str, str] | None = None) -> DataFrame:
    """``mirror`` for pairs that carry columns of both sides: ``project_a`` and ``weight_a`` change
    with those of b, ``x_a`` or ``x`` with ``x_b``, and those of ``also`` with each other. What was
    looked up or worked out for a pair serves both its rows."""
    known = set(df.columns)
    other = {"project_a": "project_b", "weight_a": "weight_b"}
    other |= {c: f"{c[:-2]}_b" for c in df.columns if c.endswith("_a")}
    other |= {c: f"{c}_b" for c in df.columns if f"{c}_b" in known}
    other |= also or {}
    other = {c: d for c, d in other.items() if c in known and d in known}
    other |= {d: c for c, d in other.items()}
    turned = df.withColumn("__turned", F.explode(F.array(F.lit(False), F.lit(True))))
    return turned.select(
        *[
            F.when(F.col("__turned"), F.col(other[c])).otherwise(F.col(c)).alias(c)
            if c in other
            else F.col(c)
            for c in df.columns
        ]
    )


def project_universe(*tables: DataFrame) -> DataFrame:
    """Distinct projects on either side of any of the pair tables."""
    sides = [
        t.select(F.explode(F.array("project_a", "project_b")).alias("project")) for t in tables
    ]
    mentioned = sides[0]
    for more in sides[1:]:
        mentioned = mentioned.unionByName(more)
    return mentioned.distinct()
