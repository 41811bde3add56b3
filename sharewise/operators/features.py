"""Per-row features of a pair whose two sides carry metadata (plain and ``_b`` columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.functions.scalars import (
    decay,
    log1p_or_zero,
    micros_between,
    naive_instant,
    parse_iso,
    per_day,
    product,
    ratio,
    whole_days,
    zeroed,
)

SIDES = ("", "_b")

# Decay rates per day, slow to fast.
DECAY_RATES = (0.0001, 0.001, 0.01)
RATE_LABELS = ("0_0001", "0_001", "0_01")

# Decayed counts: feature stem -> count column.
_DECAYED = {"stars": "stars", "forks": "forks", "issues": "open_issues"}
# Shares of side a in the sum of both sides: feature -> count column.
_SHARES = {
    "stars_ratio": "stars",
    "watchers_ratio": "watchers",
    "forks_ratio": "forks",
    "size_ratio": "size",
    "issues_ratio": "open_issues",
    "subscribers_count_ratio": "subscribers_count",
}
_SECONDS_PER_DAY = 24 * 3600


def parsed_dates(dimension: DataFrame, strict: bool = True) -> DataFrame:
    """A dimension with its two dates parsed, once per project instead of once per pair.

    Text that is no date is kept in ``created_bad`` and ``updated_bad``: whether it stops the
    job is decided by ``temporal_features``, for the projects that a pair mentions.
    """
    if not {"created_at", "updated_at"} <= set(dimension.columns):
        return dimension
    known = {}
    for stem in ("created", "updated"):
        text = F.col(f"{stem}_at")
        good = parse_iso(text, strict=False).isNotNull()
        known[f"{stem}_dt"] = F.when(good, parse_iso(text, strict))
        known[f"{stem}_bad"] = F.when(~good, text)
    return dimension.withColumns(known)


def temporal_features(
    df: DataFrame,
    as_of: str,
    true_days: bool = False,
    strict: bool = True,
    sides: Sequence[str] = SIDES,
) -> DataFrame:
    """``created_dt``, ``updated_dt``, ``days_since_update`` and ``age_days`` for both ``sides``,
    or for that of side a alone, as a dimension has it.

    ``as_of`` stands where a wall clock would, so that results repeat. ``age_days`` runs from
    creation to last update and is in microseconds over 86400, that is a million times the
    days; ``true_days`` gives days. Without the two timestamp columns nothing is added.
    Dates that ``parsed_dates`` has left with the dimension are taken as they are.
    """
    if not {"created_at", "updated_at"} <= set(df.columns):
        return df
    now = naive_instant(as_of)
    names = [(stem, side) for side in sides for stem in ("created", "updated")]

    def date(stem, side):
        if f"{stem}_bad{side}" not in df.columns:
            return parse_iso(F.col(f"{stem}_at{side}"), strict)
        bad = F.col(f"{stem}_bad{side}")
        return F.when(bad.isNull(), F.col(f"{stem}_dt{side}")).otherwise(parse_iso(bad, strict))

    parsed = {f"{stem}_dt{side}": date(stem, side) for stem, side in names}
    unit = _SECONDS_PER_DAY * (1_000_000 if true_days else 1)
    spans = {}
    for side in sides:
        created, updated = F.col(f"created_dt{side}"), F.col(f"updated_dt{side}")
        spans[f"days_since_update{side}"] = whole_days(updated, now)
        spans[f"age_days{side}"] = micros_between(created, updated) / F.lit(float(unit))
    df = df.withColumns(parsed).withColumns(spans)
    return df.drop(*[f"{stem}_bad{side}" for stem, side in names])


def decay_name(stem: str, side: str, label: str) -> str:
    return f"{stem}_decay{side}_{label}"


def activity_features(df: DataFrame) -> DataFrame:
    """Counts faded by the days since the last update, and issue interactions."""
    faded = {
        decay_name(stem, side, label): decay(
            F.col(count + side), F.col("days_since_update" + side), rate
        )
        for rate, label in zip(DECAY_RATES, RATE_LABELS)
        for stem, count in _DECAYED.items()
        for side in SIDES
    }
    crossed = {
        f"{stem}_issues_interaction{side}": product(
            zeroed(F.col(stem + side)), zeroed(F.col("open_issues" + side))
        )
        for stem in ("stars", "forks")
        for side in SIDES
    }
    return df.withColumns({**faded, **crossed})


def decay_sides() -> dict[str, str]:
    """Decay columns of side a with those of side b, whose names do not end in ``_b``."""
    labelled = [(stem, label) for stem in _DECAYED for label in RATE_LABELS]
    return {decay_name(stem, "", label): decay_name(stem, "_b", label) for stem, label in labelled}


def ratio_features(df: DataFrame) -> DataFrame:
    """Side-a shares, interactions, per-day rates and log counts. Needs ``age_days``."""
    return share_features(own_features(df), df.columns)


def share_features(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """Side-a shares in the sum of both sides, put after the columns ``first``."""
    shares = {
        name: ratio(F.col(count), F.col(count) + F.col(f"{count}_b"))
        for name, count in _SHARES.items()
    }
    rest = [c for c in df.columns if c not in first and c not in shares]
    ahead = [c for c in first if c not in shares]
    return df.withColumns(shares).select(*ahead, *shares, *rest)


def own_features(df: DataFrame, sides: Sequence[str] = SIDES) -> DataFrame:
    """Interactions, per-day rates and log counts, each of one side. Needs ``age_days``."""
    own = {}
    for side in sides:
        stars, forks, watchers, age = (
            F.col(stem + side) for stem in ("stars", "forks", "watchers", "age_days")
        )
        own[f"stars_forks_interaction{side}"] = product(stars, forks)
        own[f"engagement_score{side}"] = product(watchers, F.col(f"subscribers_count{side}"))
        own[f"stars_per_day{side}"] = per_day(stars, age)
        own[f"forks_per_day{side}"] = per_day(forks, age)
        for stem in ("stars", "watchers", "forks"):
            own[f"log_{stem}{side}"] = log1p_or_zero(F.col(stem + side))
    return df.withColumns(own)


#: Per-day rates of a project.
RATES = ("stars_per_day", "forks_per_day")


def project_rates(dimension: DataFrame, as_of: str) -> DataFrame:
    """``project_id``, its per-day rates, and ``undated``: a date's text that is none."""
    dated = parsed_dates(dimension).withColumn("undated", F.coalesce("created_bad", "updated_bad"))
    own = own_features(temporal_features(dated, as_of, strict=False, sides=SIDES[:1]), SIDES[:1])
    return own.select("project_id", "undated", *RATES)


def dated_rates(df: DataFrame) -> DataFrame:
    """Pairs with ``project_rates`` on both sides: text that is no date stops the job here."""
    checked = {}
    for side in SIDES:
        bad = F.col(f"undated{side}")
        stop = parse_iso(bad).cast("string").cast("double")  # raises
        checked |= {n + side: F.when(bad.isNull(), F.col(n + side)).otherwise(stop) for n in RATES}
    return df.withColumns(checked).drop(*[f"undated{side}" for side in SIDES])
