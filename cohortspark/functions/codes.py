"""Code strings: dots, wildcards, prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_code(code: Column | str) -> Column:
    """The code without dots, so ``714.0`` and ``7140`` agree."""
    return F.replace(_col(code), F.lit("."), F.lit(""))


def starts_with_any(code: Column | str, prefixes: Sequence[str], normalize: bool = True) -> Column:
    """Whether the code begins with one of ``prefixes``; false without any.

    With ``normalize`` dots count on neither side. Scans cannot test the normalised text, so the
    prefixes' first characters (a dot may stand before them) are also asked of the raw one.
    """
    wanted = sorted({p.replace(".", "") if normalize else p for p in prefixes})
    if not wanted:
        return F.lit(False)
    exact = _any(normalise_code(code) if normalize else _col(code), wanted)
    if not normalize or "" in wanted:
        return exact
    return exact & _any(_col(code), sorted({p[0] for p in wanted} | {"."}))


def _any(code: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


def strip_wildcard(code: str) -> str:
    """A code pattern without its trailing ``x`` and ``.`` (driver side)."""
    return code.rstrip("x").rstrip(".")


def prefix_of(code: Column | str, length: int = 3) -> Column:
    """The first ``length`` characters."""
    return F.substring(_col(code), 1, length)
