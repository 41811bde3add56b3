from sharewise.functions.scalars import (
    clip_low,
    decay,
    log1p_or_zero,
    parse_iso,
    per_day,
    product,
    project_id,
    ratio,
    whole_days,
    zeroed,
)
from sharewise.functions.stats import error_correlation, mse

__all__ = [
    "clip_low", "decay", "error_correlation", "log1p_or_zero", "mse", "parse_iso", "per_day",
    "product", "project_id", "ratio", "whole_days", "zeroed",
]
