"""Project metadata as a dimension, joined to both sides of the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.operators.joins import counts_for, lookup_join, side_counts
from sharewise.operators.pairs import mirror_sides

# Metadata fields and the names the features use for them.
_RENAMED = {
    "is_private": "private",
    "description": "description",
    "created_at": "created_at",
    "updated_at": "updated_at",
    "size": "size",
    "stars": "stargazers_count",
    "watchers": "watchers_count",
    "language": "language",
    "has_projects": "has_projects",
    "has_pages": "has_pages",
    "has_wiki": "has_wiki",
    "has_discussions": "has_discussions",
    "forks": "forks_count",
    "is_archived": "archived",
    "is_disabled": "disabled",
    "open_issues": "open_issues_count",
    "subscribers_count": "subscribers_count",
}


def project_dimension(metadata: DataFrame) -> DataFrame:
    """One row per metadata record: lower-cased key, feature names, homepage flag.

    An empty homepage is a homepage; only null is none.
    """
    return metadata.select(
        F.lower("full_name").alias("project_id"),
        F.col("homepage").isNotNull().alias("has_homepage"),
        *[F.col(source).alias(name) for name, source in _RENAMED.items()],
    )


def missing_metadata(projects: DataFrame, dimension: DataFrame) -> DataFrame:
    """Projects asked for that the dimension does not hold: what a refresh has to fetch."""
    known = dimension.select(F.col("project_id").alias("project"))
    return projects.join(known, "project", "left_anti")


#: Cells in a row of the key sketch, and rows.
WIDTH, DEPTH = 1 << 14, 3


def side_columns(dimension: DataFrame, side: str) -> DataFrame:
    """The dimension as it appears on one side: plain names for a, ``_b`` names for b."""
    suffix = "" if side == "a" else "_b"
    return dimension.select(
        F.col("project_id").alias(f"project_{side}"),
        *[F.col(c).alias(c + suffix) for c in dimension.columns if c != "project_id"],
    )


def attach_metadata(
    pairs: DataFrame, dimension: DataFrame, fold_case: bool = False, mirrored: bool = False
) -> DataFrame:
    """Left-join the dimension to side a (plain names) and to side b (``_b`` names).

    The key side is lower-cased, the pair side only with ``fold_case``; by default a
    mixed-case pair id therefore finds nothing. Duplicate keys fan out (see ``fanout_audit``).
    With ``mirrored`` the rows are those of ``mirror(pairs)``, but a pair is looked up once.
    """
    out, named = pairs, (lambda c: F.lower(c)) if fold_case else F.col
    counts = side_counts(pairs, named)  # counted before any join, so no join is run twice
    for side in ("a", "b"):
        key = f"project_{side}"
        lookup = side_columns(dimension, side)
        if fold_case:
            folded = f"__folded_{side}"
            lookup = lookup.withColumnRenamed(key, folded)
            out = out.withColumn(folded, F.lower(key))
            key = folded
        out = lookup_join(out, lookup, key, ["id"], counts=counts_for(counts, key))
        if fold_case:
            out = out.drop(key)
    return mirror_sides(out) if mirrored else out


def fanout_audit(
    pairs: DataFrame, dimension: DataFrame, mirrored: bool = False
) -> DataFrame:
    """Row counts before the two metadata joins, after the first and after both.

    Worked out from key counts, so nothing is fanned out to find how far it would fan out. With
    ``mirrored`` the counts are those of ``mirror(pairs)``, from one lookup per pair and side.
    """
    copies = dimension.groupBy("project_id").agg(F.count(F.lit(1)).alias("copies"))
    counted, counts = pairs.select("id", "project_a", "project_b"), side_counts(pairs)
    for side in ("a", "b"):
        lookup = copies.select(
            F.col("project_id").alias(f"project_{side}"),
            F.col("copies").alias(f"copies_{side}"),
        )
        key = f"project_{side}"
        counted = lookup_join(counted, lookup, key, ["id"], counts=counts_for(counts, key))
    hits = [F.coalesce(f"copies_{side}", F.lit(1)) for side in ("a", "b")]

    lost = [F.col(f"copies_{side}").isNull().cast("bigint") for side in ("a", "b")]
    one, both, lost_a, lost_b = hits[0], hits[0] * hits[1], *lost
    if mirrored:
        one, both, lost_a, lost_b = hits[0] + hits[1], 2 * both, lost[0] + lost[1], lost[0] + lost[1]

    def rows(n):
        return F.coalesce(F.sum(n), F.lit(0))

    return counted.agg(
        rows(F.lit(2 if mirrored else 1)).alias("rows_before"),
        rows(one).alias("rows_after_a"),
        rows(both).alias("rows_after_b"),
        F.sum(lost_a).alias("unmatched_a"),
        F.sum(lost_b).alias("unmatched_b"),
    )


class Fanout(ValueError):
    """A join that would make more rows than it may."""


def fanout_forecast(
    pairs: DataFrame, dimension: DataFrame, width: int = WIDTH, depth: int = DEPTH
) -> DataFrame:
    """Bounds of the row counts of ``fanout_audit`` before any join: ``rows_before``,
    ``most_after_a`` and ``most_after_b``, never below the exact counts.

    A count-min sketch of the dimension's keys has ``depth`` rows of ``width`` cells, each with
    the number of keys that fall into it, so no key has more copies than its cell. Pairs are
    read once, looking up cells: a pair makes at most as many rows as the cells of its two
    sides say. No pair is shuffled, and what travels is the sketch, of one size whatever the
    tables. The least of the ``depth`` sums is the bound; it is loose where far more keys than
    ``width`` share the cells.
    """

    def slot(key: str, row: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(row), key), F.lit(width)) + row * width

    keys = dimension.filter("project_id is not null")
    slots = F.explode(F.array(*[slot("project_id", row) for row in range(depth)]))
    counts = keys.select(slots.alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    grid = pairs.sparkSession.range(depth * width).withColumnRenamed("id", "slot")
    cells = grid.join(counts, "slot", "left").agg(
        F.sort_array(F.collect_list(F.struct("slot", F.coalesce("n", F.lit(0)).alias("n"))))
        .getField("n").alias("cells")
    )
    sketch = cells.scalar()

    def copies(side: str, row: int) -> Column:
        return F.greatest(sketch[slot(f"project_{side}", row).cast("int")], F.lit(1))

    one = [F.sum(copies("a", row)) for row in range(depth)]
    both = [F.sum(copies("a", row) * copies("b", row)) for row in range(depth)]
    none = F.lit(0).cast("bigint")
    return pairs.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.coalesce(F.least(*one), none).alias("most_after_a"),
        F.coalesce(F.least(*both), none).alias("most_after_b"),
    )


def check_fanout(pairs: DataFrame, dimension: DataFrame, times: float) -> None:
    """Stop before a metadata join that may make over ``times`` as many rows as there are
    pairs. A bound over the limit is looked at again by the exact audit."""
    row = fanout_forecast(pairs, dimension).first()
    limit = times * row["rows_before"]
    if row["most_after_b"] <= limit:
        return
    exact = fanout_audit(pairs, dimension).first()
    if exact["rows_after_b"] > limit:
        raise Fanout(f"{row['rows_before']} pairs would become {exact['rows_after_b']} rows")
