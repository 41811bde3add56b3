"""Column expressions. All are built-in Spark functions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host delimiter of project URLs and the timestamp layout of repository metadata.
URL_DELIMITER = "github.com/"
ISO_LAYOUT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def project_id(url: Column) -> Column:
    """Text after the last host delimiter; the whole text when there is none."""
    return F.substring_index(url, URL_DELIMITER, -1)


def parse_iso(text: Column, strict: bool = True) -> Column:
    """ISO text to a zone-free timestamp. Bad text raises when ``strict``, else becomes null."""
    if strict:
        return F.to_timestamp_ntz(text, F.lit(ISO_LAYOUT))
    return F.try_to_timestamp(text, F.lit(ISO_LAYOUT)).cast("timestamp_ntz")


def naive_instant(text: str) -> Column:
    """``2002-01-01 12:00:00`` as a zone-free literal, whatever the session zone is."""
    return F.lit(text).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days from start to end, truncated toward zero."""
    return F.timestamp_diff("DAY", start, end)


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def zeroed(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division that never raises: 0/0 is NaN, x/0 is +-inf, null stays null."""
    n, d = numerator.cast("double"), denominator.cast("double")
    by_zero = (
        F.when(n == 0, F.lit(float("nan")))
        .when(n > 0, F.lit(float("inf")))
        .when(n < 0, F.lit(float("-inf")))
    )
    return F.when(d == 0, by_zero).otherwise(n / d)


def product(left: Column, right: Column) -> Column:
    """Multiply counts as doubles, out of reach of 64-bit overflow."""
    return left.cast("double") * right.cast("double")


def decay(count: Column, days: Column, rate: float) -> Column:
    return count * F.exp(F.lit(-rate) * days)


def per_day(count: Column, days: Column) -> Column:
    """Count over days, with days floored at 1 (a null age counts as 1)."""
    return count / F.greatest(days, F.lit(1.0))


def log1p_or_zero(count: Column) -> Column:
    return F.log1p(zeroed(count).cast("double"))


def clip_low(value: Column, digits: int = 6) -> Column:
    """Round half up, then floor at zero. There is no upper bound, and null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.round(value, digits), F.lit(0.0)))
