"""Declared schemas. Reading with them costs no inference pass."""

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_S, _D, _L, _B, _TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampNTZType(),
)

TRAIN_PAIRS = _fields(
    ("id", _L), ("project_a", _S), ("project_b", _S), ("weight_a", _D), ("weight_b", _D),
)
TEST_PAIRS = _fields(("id", _L), ("project_a", _S), ("project_b", _S))

REPO_METADATA = _fields(
    ("full_name", _S), ("private", _B), ("description", _S), ("created_at", _S),
    ("updated_at", _S), ("homepage", _S), ("size", _L), ("stargazers_count", _L),
    ("watchers_count", _L), ("language", _S), ("has_projects", _B), ("has_pages", _B),
    ("has_wiki", _B), ("has_discussions", _B), ("forks_count", _L), ("archived", _B),
    ("disabled", _B), ("open_issues_count", _L), ("subscribers_count", _L),
)

OSS_FUNDING = _fields(
    ("time", _TS), ("from_project_name", _S), ("grant_pool_name", _S),
    ("to_project_name", _S), ("to_project_id", _L), ("amount", _D),
)

REPOSITORIES = _fields(
    ("project_id", _L), ("artifact_url", _S), ("star_count", _L), ("is_fork", _B),
    ("fork_count", _L), ("created_at", _TS), ("updated_at", _TS),
)
