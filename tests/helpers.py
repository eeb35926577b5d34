"""Small helpers shared by the tests."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from cohortspark.session import local_table


def table(spark, rows, schema):
    return local_table(spark, rows, schema)


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def lcg(n, seed=1):
    """Reproducible numbers in [0, 1)."""
    x, out = seed, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(x / 2**31)
    return out
