"""Column expressions. All of them stay inside the JVM."""

from .codes import normalise_code, prefix_of, strip_wildcard
from .numbers import (
    clip,
    is_finite,
    nan_to_null,
    percent,
    ratio_text,
    rescale,
    safe_divide,
    score_mean,
)
from .times import as_timestamp, epoch_micros, hours_between, within_hours

__all__ = [
    "as_timestamp",
    "clip",
    "epoch_micros",
    "hours_between",
    "is_finite",
    "nan_to_null",
    "normalise_code",
    "percent",
    "prefix_of",
    "ratio_text",
    "rescale",
    "safe_divide",
    "score_mean",
    "strip_wildcard",
    "within_hours",
]
