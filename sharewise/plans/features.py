"""From pairs and metadata to the columns a model is trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.operators.features import (
    activity_features,
    decay_sides,
    own_features,
    parsed_dates,
    share_features,
    temporal_features,
)
from sharewise.operators.metadata import attach_metadata
from sharewise.operators.pairs import mirror_sides

# The training columns, in order. Decay columns spell the rate with an
# underscore, because a dot in a column name needs quoting.
TRAINING_FEATURES = [
    "is_private",
    "has_homepage",
    "size",
    "stars",
    "watchers",
    "has_projects",
    "has_pages",
    "has_wiki",
    "has_discussions",
    "forks",
    "is_archived",
    "is_disabled",
    "open_issues",
    "subscribers_count",
    "is_private_b",
    "has_homepage_b",
    "size_b",
    "stars_b",
    "watchers_b",
    "has_projects_b",
    "has_pages_b",
    "has_wiki_b",
    "has_discussions_b",
    "forks_b",
    "is_archived_b",
    "is_disabled_b",
    "open_issues_b",
    "subscribers_count_b",
    "age_days",
    "age_days_b",
    "days_since_update",
    "days_since_update_b",
    "stars_decay_0_0001",
    "stars_decay_b_0_0001",
    "forks_decay_0_0001",
    "forks_decay_b_0_0001",
    "issues_decay_0_0001",
    "issues_decay_b_0_0001",
    "stars_decay_0_001",
    "stars_decay_b_0_001",
    "forks_decay_0_001",
    "forks_decay_b_0_001",
    "issues_decay_0_001",
    "issues_decay_b_0_001",
    "stars_decay_0_01",
    "stars_decay_b_0_01",
    "forks_decay_0_01",
    "forks_decay_b_0_01",
    "issues_decay_0_01",
    "issues_decay_b_0_01",
    "stars_ratio",
    "watchers_ratio",
    "forks_ratio",
    "size_ratio",
    "stars_forks_interaction",
    "stars_forks_interaction_b",
    "engagement_score",
    "engagement_score_b",
    "stars_per_day",
    "stars_per_day_b",
    "forks_per_day",
    "forks_per_day_b",
    "log_stars",
    "log_stars_b",
    "log_watchers",
    "log_watchers_b",
    "log_forks",
    "log_forks_b",
]

# The older, shorter list, without its four columns that no longer exist.
SHORT_FEATURES = [
    "is_private",
    "has_homepage",
    "size",
    "stars",
    "watchers",
    "has_projects",
    "has_pages",
    "has_wiki",
    "has_discussions",
    "forks",
    "is_archived",
    "is_disabled",
    "open_issues",
    "subscribers_count",
    "is_private_b",
    "has_homepage_b",
    "size_b",
    "stars_b",
    "watchers_b",
    "has_projects_b",
    "has_pages_b",
    "has_wiki_b",
    "has_discussions_b",
    "forks_b",
    "is_archived_b",
    "is_disabled_b",
    "open_issues_b",
    "subscribers_count_b",
    "stars_ratio",
    "watchers_ratio",
    "forks_ratio",
    "size_ratio",
    "age_days",
    "age_days_b",
    "days_since_update",
    "days_since_update_b",
    "log_stars",
    "log_stars_b",
    "log_watchers",
    "log_watchers_b",
    "log_forks",
    "log_forks_b",
]

MISSING = -1.0


def pair_features(
    pairs: DataFrame,
    dimension: DataFrame,
    as_of: str,
    fold_case: bool = False,
    mirrored: bool = False,
) -> DataFrame:
    """Metadata of both sides and every derived feature. One lazy plan, no Python.

    With ``mirrored`` the rows are those of ``mirror(pairs)``; metadata, dates and features that
    belong to one side are looked up, parsed and worked out once per pair, only shares per row.
    """
    df = attach_metadata(pairs, parsed_dates(dimension), fold_case)
    df = activity_features(temporal_features(df, as_of))
    first, df = df.columns, own_features(df)
    df = mirror_sides(df, decay_sides()) if mirrored else df
    return share_features(df, first)


def flag_name(feature: str) -> str:
    return f"{feature}_missing"


def numeric_columns(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """``keep`` as it is and ``features`` as doubles, with NaN and infinity turned to null."""
    kinds = dict(df.dtypes)
    columns = [F.col(c) for c in keep]
    for name in features:
        value = F.col(name).cast("double")
        if kinds[name] in ("double", "float"):
            finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
            value = F.when(finite, value)
        columns.append(value.alias(name))
    return df.select(*columns)


def fill_missing(
    df: DataFrame, features: Sequence[str], flags: bool = True
) -> DataFrame:
    """Nulls of ``features`` become ``MISSING``, plus a 0/1 column with ``flags``.

    With the flag a tree can send missing rows either way. Applied to staged columns, after
    the features are computed, so that no feature is computed twice.
    """
    filled = {f: F.coalesce(f, F.lit(MISSING)) for f in features}
    if flags:
        filled |= {flag_name(f): F.col(f).isNull().cast("double") for f in features}
    return df.withColumns(filled)


def model_inputs(features: Sequence[str], flags: bool = True) -> list[str]:
    """Names of the vector's entries, in order."""
    if not flags:
        return list(features)
    return [name for f in features for name in (f, flag_name(f))]


def assembler(features: Sequence[str], flags: bool = True) -> VectorAssembler:
    return VectorAssembler(
        inputCols=model_inputs(features, flags), outputCol="features", handleInvalid="error"
    )
