"""Do the weights of a pair table agree with each other?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.operators.folds import places
from sharewise.operators.joins import key_counts, lookup_join
from sharewise.session import stage

TOLERANCE = 1e-6


def weight_sum_check(pairs: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """One row: how many pairs have weights that do not add up to 1, and the largest gap.
    A missing weight counts as a violation."""
    gap = F.abs(F.col("weight_a") + F.col("weight_b") - 1)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(gap > tol, F.lit(True))).alias("n_violations"),
        F.max(gap).alias("max_gap"),
    )


def mirror_violations(mirrored: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Pairs (per id) whose two directions are not equal in number or whose weights do not
    complement each other.

    Both directions meet under one unordered key and are compared by count, extremes and sum,
    so repeated rows are folded on the map side instead of being matched with each other.
    """
    a, b, w = F.col("project_a"), F.col("project_b"), F.col("weight_a")
    there, back = a < b, a > b
    grouped = mirrored.groupBy(
        "id", F.least(a, b).alias("first"), F.greatest(a, b).alias("second")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(w).alias("n_weights"),
        F.count_if(there).alias("n_there"),
        F.count_if(back).alias("n_back"),
        F.sum(w).alias("total"),
        F.max(F.when(there, w)).alias("there_max"),
        F.min(F.when(there, w)).alias("there_min"),
        F.max(F.when(back, w)).alias("back_max"),
        F.min(F.when(back, w)).alias("back_min"),
    )
    gap = F.greatest(
        F.abs(F.col("there_max") + F.col("back_min") - 1),
        F.abs(F.col("there_min") + F.col("back_max") - 1),
        F.abs(F.col("total") - F.col("n") / 2) / F.col("n"),
    )
    bad = (
        (F.col("n_there") != F.col("n_back"))
        | (F.col("n_weights") != F.col("n"))
        | (gap > tol)
    )
    return grouped.withColumn("gap", gap).filter(F.coalesce(bad, F.lit(True))).select(
        "id", "first", "second", "n_there", "n_back", "gap"
    )


def edges(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair ``x < y`` with the mean weight of each end."""
    forward = F.col("project_a") < F.col("project_b")
    return (
        pairs.filter(F.col("project_a") != F.col("project_b"))
        .groupBy(
            F.least("project_a", "project_b").alias("x"),
            F.greatest("project_a", "project_b").alias("y"),
        )
        .agg(
            F.avg(F.when(forward, F.col("weight_a")).otherwise(F.col("weight_b"))).alias("wx"),
            F.avg(F.when(forward, F.col("weight_b")).otherwise(F.col("weight_a"))).alias("wy"),
        )
    )


def _step(w_from, w_to):
    """Log of to/from; null when either weight is not positive."""
    return F.when((w_from > 0) & (w_to > 0), F.ln(w_to) - F.ln(w_from))


def _numbered(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges as numbers ``u < v`` from the less to the more compared end, and ``(project,
    number)``: places in the order of degree, then name."""
    ends = e.select(F.explode(F.array("x", "y")).alias("project"))
    degree = stage(ends.groupBy("project").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    size = "int" if degree.count() < 1 << 31 else "bigint"
    numbers = places(degree, "degree", "project").select(
        "project", F.col("rank").cast(size).alias("number"), F.col("degree").alias("__n")
    )
    numbers = stage(numbers, "numbers")
    found = e.select("x", "y")
    for end, other in (("x", "y"), ("y", "nx")):
        known = numbers.select(F.col("project").alias(end), F.col("number").alias(f"n{end}"))
        counts = numbers.select(F.col("project").alias(end), "__n")
        found = lookup_join(found, known, end, [other], counts=counts).drop(end)
    out = found.select(F.least("nx", "ny").alias("u"), F.greatest("nx", "ny").alias("v"))
    return stage(out, "numbered"), numbers.drop("__n")


def _closed(out: DataFrame) -> DataFrame:
    """``u, v, w`` of every triangle of numbered edges."""
    corners = out.groupBy("u").agg(F.collect_list("v").alias("ends"))
    # An edge closes only if its low end has another edge and its high end has any.
    from_u = corners.filter("size(ends) > 1").withColumnRenamed("ends", "from_u")
    from_v = corners.select(F.col("u").alias("v"), F.col("ends").alias("from_v"))
    met = lookup_join(out, from_v, "v", ["u"], how="inner", counts=key_counts(out, "v"))
    met = lookup_join(met, from_u, "u", ["v"], how="inner", counts=key_counts(out, "u"))
    shared = F.array_intersect("from_u", "from_v")
    return met.select("u", "v", F.explode(shared).alias("w"))


def triples(pairs: DataFrame) -> DataFrame:
    """Every triple of projects compared all three ways, with two verdicts.

    ``log_gap`` is |ln(c/a) - ln(c/b) - ln(b/a)|: zero when the ratios multiply up.
    ``order_violation``: some x > y and y > z without x > z.

    Each edge points from its less compared to its more compared end, so a project compared
    with a third of all others keeps few outgoing edges: with m edges no project has more than
    sqrt(2 m). These bounded lists meet at every edge that can close, and what both ends of the
    edge point to are the third corners: no pair of edges is emitted that does not close. Up
    to there projects are numbers, in the order that gives the directions; names and weights
    are joined to closed triples only, the three sides of a triple as rows. A project that very
    many edges point to is split by the lookup. Edges are staged, with names and as numbers, so
    building the plan does not repeat what led to them.
    """
    e = stage(edges(pairs), "edges")
    out, numbers = _numbered(e)
    named = _closed(out)
    for corner in ("u", "v", "w"):
        name = numbers.select(F.col("number").alias(corner), F.col("project").alias(f"name_{corner}"))
        named = named.join(name, corner).drop(corner).withColumnRenamed(f"name_{corner}", corner)

    def side(tail: str, head: str, at: int):
        ends = (F.least(tail, head).alias("x"), F.greatest(tail, head).alias("y"))
        return F.struct(F.lit(at).alias("side"), (F.col(tail) < F.col(head)).alias("along"), *ends)

    sides = F.array(side("u", "v", 0), side("v", "w", 1), side("u", "w", 2))
    weighed = named.select("u", "v", "w", F.inline(sides)).join(e, ["x", "y"])
    along, wx, wy = F.col("along"), F.col("wx"), F.col("wy")
    tail, head = F.when(along, wx).otherwise(wy), F.when(along, wy).otherwise(wx)
    steps = weighed.select(
        "u", "v", "w", "side", F.sign(head - tail).alias("sign"), _step(tail, head).alias("log")
    )
    cycle = steps.groupBy("u", "v", "w").agg(
        *[
            F.max(F.when(F.col("side") == at, F.col(what))).alias(f"{what}_{name}")
            for at, name in enumerate(("uv", "vw", "uw"))
            for what in ("sign", "log")
        ]
    )
    # Walking u -> v -> w -> u, the last step goes against its edge.
    signs = [F.col("sign_uv"), F.col("sign_vw"), -F.col("sign_uw")]
    ups = sum((s > 0).cast("int") for s in signs)
    downs = sum((s < 0).cast("int") for s in signs)
    names = F.array_sort(F.array("u", "v", "w"))
    return cycle.select(
        names[0].alias("a"),
        names[1].alias("b"),
        names[2].alias("c"),
        F.abs(F.col("log_uv") + F.col("log_vw") - F.col("log_uw")).alias("log_gap"),
        (((ups >= 2) & (downs == 0)) | ((downs >= 2) & (ups == 0))).alias("order_violation"),
    )


def triple_summary(pairs: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """One row: triples, those off by more than ``tol``, those without a ratio (a weight that
    is not positive), those out of order, and the largest gap."""
    return triples(pairs).agg(
        F.count(F.lit(1)).alias("n_triples"),
        F.count_if(F.col("log_gap") > tol).alias("n_ratio_violations"),
        F.count_if(F.col("log_gap").isNull()).alias("n_undefined"),
        F.count_if("order_violation").alias("n_order_violations"),
        F.max("log_gap").alias("max_log_gap"),
    )


def is_consistent(pairs: DataFrame, tol: float = TOLERANCE) -> bool:
    """True when no triple breaks the ratio rule or the order rule."""
    broken = (F.col("log_gap") > tol) | F.col("log_gap").isNull() | F.col("order_violation")
    return triples(pairs).filter(broken).isEmpty()
