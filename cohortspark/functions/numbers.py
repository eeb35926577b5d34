"""Numeric helpers with zero and null guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(value: Column | str) -> Column:
    v = _col(value).cast("double")
    return F.when(~F.isnan(v), v)


def is_finite(value: Column | str) -> Column:
    """False for null, NaN and both infinities."""
    v = _col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def clip(value: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    v = _col(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def rescale(value: Column | str, low: float, high: float) -> Column:
    """Linear position between ``low`` and ``high``, clipped to [0, 1]."""
    return clip((_col(value) - F.lit(low)) / F.lit(high - low))


def safe_divide(top: Column | str, bottom: Column | str, empty: float | None = 0.0) -> Column:
    t, b = _col(top).cast("double"), _col(bottom).cast("double")
    return F.when(b != 0, t / b).otherwise(F.lit(empty).cast("double"))


def percent(top: Column | str, bottom: Column | str) -> Column:
    return safe_divide(_col(top) * F.lit(100.0), bottom)


def ratio_text(positive: Column | str, negative: Column | str) -> Column:
    """``1:n`` text with one decimal, or ``N/A`` without positives."""
    p, n = _col(positive), _col(negative)
    return F.when(
        p > 0, F.format_string("1:%.1f", n.cast("double") / p.cast("double"))
    ).otherwise(F.lit("N/A"))


def score_mean(flags: Sequence[str]) -> Column:
    """Row-wise mean over 0/1 columns."""
    return reduce(add, [F.col(f).cast("double") for f in flags]) / F.lit(float(len(flags)))


def t_two_sided(t: str, dof: str) -> str:
    """SQL of the two-sided p value of Student's t, for any positive real degrees of freedom.

    The value is the regularised incomplete beta I_x(dof / 2, 1 / 2) at x = dof / (dof + t^2), by its continued
    fraction on the side where that converges fast; the number of steps follows the square root of ``dof``.
    Null if either input is null; 1 at t = 0.
    """
    a = f"(({dof}) / 2D)"
    over = f"(({t}) * ({t}) / ({dof}))"
    # ln of gamma(a + 1/2) / gamma(a): sixteen recurrence steps, then the asymptotic series at z = a + 16
    shift = " * ".join(f"(({a} + {i}D) / ({a} + {i}.5D))" for i in range(16))
    z = f"({a} + 16D)"
    series = (
        f"(0.5D * ln({z}) - 1D / (8D * {z}) + 1D / (192D * power({z}, 3)) - 1D / (640D * power({z}, 5))"
        f" + 17D / (14336D * power({z}, 7)))"
    )
    front = f"exp(-{a} * log1p({over}) + {series}) * ({shift}) * sqrt({over} / (1D + {over})) / sqrt(pi())"
    direct = f"(1D / (1D + {over}) < ({a} + 1D) / ({a} + 2.5D))"
    start = (
        f"named_struct('a', if({direct}, {a}, 0.5D), 'b', if({direct}, 0.5D, {a}),"
        f" 'x', if({direct}, 1D / (1D + {over}), {over} / (1D + {over})))"
    )
    first = "1D / (1D - (v.a + v.b) * v.x / (v.a + 1D))"
    even = "k * (v.b - k) * v.x / ((v.a - 1D + 2D * k) * (v.a + 2D * k))"
    odd = "-(v.a + k) * (v.a + v.b + k) * v.x / ((v.a + 2D * k) * (v.a + 1D + 2D * k))"

    def step(state, term):
        inner = f"transform(array({state}), s -> named_struct('c', 1D + ({term}) / s.c, 'd', 1D / (1D + ({term}) * s.d), 'h', s.h))[0]"
        return f"transform(array({inner}), s -> named_struct('c', s.c, 'd', s.d, 'h', s.h * s.c * s.d))[0]"

    fraction = (
        f"transform(array({start}), v -> aggregate(transform(sequence(1, 200 + CAST(4 * sqrt({a}) AS INT)), i -> CAST(i AS DOUBLE)),"
        f" named_struct('c', 1D, 'd', {first}, 'h', {first}),"
        f" (acc, k) -> {step(step('acc', even), odd)}, acc -> acc.h / v.a))[0]"
    )
    beta = f"({front}) * ({fraction})"
    return (
        f"CASE WHEN ({t}) = 0D THEN 1D WHEN ({t}) IS NOT NULL AND ({dof}) > 0D THEN"
        f" if({direct}, {beta}, 1D - {beta}) END"
    )
