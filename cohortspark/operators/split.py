"""Exact, reproducible splits and folds.

A split is decided by a few cut rows found from counts; assigning the rows is then
a projection over the scan (random, temporal) or a join with one row per class
(stratified). Keys must be unique for the part sizes to be exact; rows that share
a key always stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_timestamp, epoch_micros
from ..session import require_columns
from .ranking import cuts_passed, hash_order, q, qs, text, time_order

PARTS = ("train", "val", "test")
_EPS = "1e-9D"


class Splitter:
    """Train, validation and test parts of exact sizes.

    With ``n`` rows the cuts lie at ``floor(n * train)`` and
    ``floor(n * (train + val))``.
    """

    def __init__(self, test_size: float = 0.2, val_size: float = 0.1):
        if not 0 < test_size < 1:
            raise ValueError(f"test_size must be between 0 and 1, not {test_size}")
        if not 0 <= val_size < 1:
            raise ValueError(f"val_size must be at least 0 and below 1, not {val_size}")
        if test_size + val_size >= 1:
            raise ValueError(f"test_size + val_size must be below 1, not {test_size + val_size}")
        self.test_size = test_size
        self.val_size = val_size
        self.train_size = 1.0 - test_size - val_size

    def _ranks(self) -> list[str]:
        cuts = (self.train_size, self.train_size + self.val_size)
        return [f"floor(n * {c!r}D + {_EPS})" for c in cuts]

    def _named(self, passed: DataFrame, columns: Sequence[str]) -> DataFrame:
        return passed.selectExpr(
            *qs(columns),
            "CASE __passed WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split",
        )

    def random(self, df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
        """``df`` plus ``split``; the order is the md5 of seed and key."""
        require_columns(df, keys)
        passed = cuts_passed(df, hash_order(keys, seed), self._ranks(), out="__passed")
        return self._named(passed, df.columns)

    def temporal(self, df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
        """Earliest rows to train, latest to test; text times are parsed."""
        require_columns(df, [time, *keys])
        timed = as_timestamp(df, time)
        passed = cuts_passed(
            timed, time_order(epoch_micros(timed, time), keys), self._ranks(), out="__passed"
        )
        return self._named(passed, df.columns)

    def stratified(
        self, df: DataFrame, stratify: str, keys: Sequence[str], seed: int = 42
    ) -> DataFrame:
        """The same cuts inside every class; rows without a class are left out."""
        require_columns(df, [stratify, *keys])
        known = df.where(f"{q(stratify)} IS NOT NULL")
        passed = cuts_passed(
            known, hash_order(keys, seed), self._ranks(), by=[stratify], out="__passed"
        )
        return self._named(passed, df.columns)


def parts(split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test) without the ``split`` column."""
    return tuple(split.where(F.col("split") == p).drop("split") for p in PARTS)


def train_test(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.3,
    stratify: str | None = None, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(train, test), stratified when a class column is given."""
    splitter = Splitter(test_size, 0.0)
    marked = (
        splitter.stratified(df, stratify, keys, seed) if stratify else splitter.random(df, keys, seed)
    )
    train, _, test = parts(marked)
    return train, test


def folds(
    df: DataFrame, k: int, keys: Sequence[str], stratify: str = "label", seed: int = 42
) -> DataFrame:
    """``df`` plus ``fold`` 0..k-1, balanced within every class to one row."""
    if k < 2:
        raise ValueError(f"k must be at least 2, not {k}")
    require_columns(df, [stratify, *keys])
    known = df.where(f"{q(stratify)} IS NOT NULL")
    ranks = [f"floor(n * {j} / {k} + {_EPS})" for j in range(1, k)]
    return cuts_passed(known, hash_order(keys, seed), ranks, by=[stratify], out="fold")


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """(class, n, pct) with the percentage rounded to two decimals."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.expr("count(1) AS n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.select("class", "n", F.round(F.lit(100.0) * F.col("n") / total, 2).alias("pct"))


def split_stats(
    split: DataFrame, strategy: str, label: str | None = "label", time: str | None = None
) -> DataFrame:
    """One row per (split, class): sizes, proportions, class shares and, when a
    time column is given, the period of the part."""
    has_label = label is not None and label in split.columns
    cls = f"CAST({q(label)} AS STRING)" if has_label else "CAST(NULL AS STRING)"
    period = (
        [f"min({q(time)}) AS t_start", f"max({q(time)}) AS t_end"] if time else []
    )
    grouped = (
        split.selectExpr("*", f"{cls} AS class")
        .groupBy("split", "class")
        .agg(F.expr("count(1) AS class_n"), *[F.expr(p) for p in period])
    )
    extra = (
        ["min(t_start) OVER (PARTITION BY split) AS t_start",
         "max(t_end) OVER (PARTITION BY split) AS t_end"]
        if time
        else []
    )
    total = grouped.select(F.sum("class_n")).scalar()
    shares = grouped.selectExpr(
        f"{text(strategy)} AS strategy",
        "split",
        "sum(class_n) OVER (PARTITION BY split) AS n",
        "sum(class_n) OVER (PARTITION BY split) AS __n",
        "class",
        "class_n",
        "round(100.0D * class_n / sum(class_n) OVER (PARTITION BY split), 2) AS class_pct",
        *extra,
    )
    return shares.withColumn("proportion", F.round(F.col("__n") / total, 6)).drop("__n")


def split_summary(stats: DataFrame) -> str:
    """Statistics as text; the table has one row per part and class."""
    lines = []
    for r in stats.orderBy("split", "class").collect():
        cls = "" if r["class"] is None else f"  class {r['class']}: {r['class_n']} ({r['class_pct']} %)"
        lines.append(f"{r['split']}: {r['n']} rows ({100 * r['proportion']:.1f} %){cls}")
    return "\n".join(lines)
