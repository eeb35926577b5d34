"""Imputation and scaling, fitted once and reusable on other rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import local_table, require_columns
from .ranking import q, quantiles, unpivot

ID_COLUMNS = ("subject_id", "label", "hadm_id")
STRATEGIES = ("median", "mean", "drop", "zero")
METHODS = ("standard", "minmax")


def feature_columns(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in ids]


def _value(name: str) -> str:
    """The column as double with NaN taken as missing."""
    return f"nanvl(CAST({q(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def _literal(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], approx: bool = False
) -> dict[str, dict[str, float]]:
    """Quantiles of many columns from one long pass; columns without values are
    absent from the result."""
    long = unpivot(df, columns)
    rows = quantiles(long, "value", probs, ["feature"], approx).collect()
    return {r["feature"]: {p: r[p] for p in probs} for r in rows}


class Imputer:
    """Fill missing feature values.

    ``median`` and ``mean`` are learned in ``fit`` for all columns together;
    ``zero`` needs no fit; ``drop`` removes rows with a missing feature. A column
    without any value stays missing. Filled features are doubles. The median is exact
    unless ``approx``.
    """

    def __init__(
        self, strategy: str = "median", ids: Sequence[str] = ID_COLUMNS, approx: bool = False
    ):
        if strategy not in STRATEGIES:
            raise ValueError(f"invalid strategy {strategy!r}; must be one of {list(STRATEGIES)}")
        self.strategy = strategy
        self.ids = tuple(ids)
        self.approx = approx
        self.fill: dict[str, float] | None = None

    def fit(self, df: DataFrame) -> "Imputer":
        features = feature_columns(df, self.ids)
        self.fill = {}
        if not features:
            return self
        if self.strategy == "median":
            found = column_quantiles(df, features, {"m": 0.5}, self.approx)
            self.fill = {f: v["m"] for f, v in found.items()}
        elif self.strategy == "mean":
            row = df.selectExpr(*[f"avg({_value(f)}) AS {q(f)}" for f in features]).first()
            self.fill = {f: row[f] for f in features if row[f] is not None}
        elif self.strategy == "zero":
            self.fill = {f: 0.0 for f in features}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fill is None:
            if self.strategy in ("median", "mean"):
                raise RuntimeError("imputer is not fitted; call fit first")
            self.fit(df)
        features = feature_columns(df, self.ids)
        if self.strategy == "drop":
            complete = " AND ".join(f"{_value(f)} IS NOT NULL" for f in features)
            return df.where(complete) if complete else df
        return df.selectExpr(
            *[
                q(c)
                if c not in features
                else f"coalesce({_value(c)}, {_literal(self.fill[c])}) AS {q(c)}"
                if c in self.fill
                else f"{_value(c)} AS {q(c)}"
                for c in df.columns
            ]
        )

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Scaler:
    """Standard or min-max scaling with the population deviation; a constant
    column becomes 0. Ids keep their place and values."""

    def __init__(self, method: str = "standard", ids: Sequence[str] = ID_COLUMNS):
        if method not in METHODS:
            raise ValueError(f"invalid method {method!r}; must be one of {list(METHODS)}")
        self.method = method
        self.ids = tuple(ids)
        self.params: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame) -> "Scaler":
        features = feature_columns(df, self.ids)
        self.params = {}
        if not features:
            return self
        if self.method == "standard":
            stats = "avg({v}) AS `a{i}`", "stddev_pop({v}) AS `b{i}`"
        else:
            stats = "min({v}) AS `a{i}`", "max({v}) - min({v}) AS `b{i}`"
        row = df.selectExpr(
            *[s.format(v=_value(f), i=i) for i, f in enumerate(features) for s in stats]
        ).first()
        for i, f in enumerate(features):
            centre, width = row[f"a{i}"], row[f"b{i}"]
            if centre is None:
                continue
            # rounding leaves a tiny spread on a constant column
            flat = not width or width <= 1e-12 * abs(centre)
            self.params[f] = (centre, 1.0 if flat else width)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.params is None:
            raise RuntimeError(f"no scaler fitted for method {self.method!r}; call fit first")
        features = feature_columns(df, self.ids)
        if not features:
            return df
        return df.selectExpr(
            *[
                q(c)
                if c not in features
                else f"({_value(c)} - {_literal(self.params[c][0])})"
                f" / {_literal(self.params[c][1])} AS {q(c)}"
                if c in self.params
                else f"{_value(c)} AS {q(c)}"
                for c in df.columns
            ]
        )

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def params_table(self, df: DataFrame) -> DataFrame:
        """(feature, centre, width) as a table, for saving with a result."""
        rows = [(f, *p) for f, p in (self.params or {}).items()]
        return local_table(df.sparkSession, rows, "feature string, centre double, width double")


def outlier_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", k: float | None = None
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column: quartiles -/+ ``k`` times their distance
    (1.5), or mean -/+ ``k`` sample deviations (3)."""
    require_columns(df, columns)
    if method == "iqr":
        width = 1.5 if k is None else k
        found = column_quantiles(df, columns, {"a": 0.25, "b": 0.75})
        return {
            c: (v["a"] - width * (v["b"] - v["a"]), v["b"] + width * (v["b"] - v["a"]))
            for c, v in found.items()
        }
    if method == "zscore":
        width = 3.0 if k is None else k
        row = df.selectExpr(
            *[
                s.format(v=_value(c), i=i)
                for i, c in enumerate(columns)
                for s in ("avg({v}) AS a{i}", "stddev_samp({v}) AS b{i}")
            ]
        ).first()
        return {
            c: (row[f"a{i}"] - width * row[f"b{i}"], row[f"a{i}"] + width * row[f"b{i}"])
            for i, c in enumerate(columns)
            if row[f"b{i}"] is not None
        }
    raise ValueError(f"method must be 'iqr' or 'zscore', not {method!r}")


def remove_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", k: float | None = None
) -> DataFrame:
    """Rows with every listed column inside its bounds; a missing value stays."""
    bounds = outlier_bounds(df, columns, method, k)
    if not bounds:
        return df
    return df.where(
        " AND ".join(
            f"({_value(c)} IS NULL OR {_value(c)} BETWEEN {_literal(lo)} AND {_literal(hi)})"
            for c, (lo, hi) in bounds.items()
        )
    )
