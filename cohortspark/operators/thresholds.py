"""One-feature threshold rules: applying them, and finding them.

A ``Finder`` fits a frame of features and a 0/1 label and yields a ``Rule``; the
rule is a plain column expression on any frame with its feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_table, require_columns
from .attribution import attribute, direction_of, summarise, top_features
from .models import Fitted, fit_logistic, fit_model
from .prepare import column_quantiles
from .ranking import q, unpivot
from .roc import check_two_classes, youden_cut, youden_cut_or_median, youden_cv
from .split import folds

HIGH, LOW = "high", "low"
STAT_SUFFIXES = ("_min", "_max", "_std", "_count")


@dataclass(frozen=True)
class Rule:
    """``feature >= threshold`` (direction high) or ``<=`` (low)."""

    feature: str
    threshold: float
    direction: str
    method: str = ""
    decimals: int | None = None
    metadata: Mapping = field(default_factory=dict)

    @property
    def formula(self) -> str:
        sign = ">=" if self.direction == HIGH else "<="
        value = self.threshold if self.decimals is None else f"{self.threshold:.{self.decimals}f}"
        return f"{self.feature} {sign} {value}"

    @property
    def features_used(self) -> list[str]:
        return [self.feature]

    def column(self) -> Column:
        """0/1 expression; null where the feature is null."""
        x, t = F.col(self.feature), F.lit(float(self.threshold))
        return (x >= t if self.direction == HIGH else x <= t).cast("int")

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        require_columns(df, [self.feature])
        return df.withColumn(out, self.column())

    def describe(self) -> str:
        facts = ", ".join(
            f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}"
            for k, v in self.metadata.items()
            if isinstance(v, (int, float, str))
        )
        return f"{self.method} rule: {self.formula}" + (f" ({facts})" if facts else "")

    def as_table(self, df: DataFrame) -> DataFrame:
        """The rule as one row, for saving."""
        weights = self.metadata.get("weights") or {}
        row = (
            self.method,
            self.feature,
            self.direction,
            float(self.threshold),
            self.formula,
            [float(t) for t in self.metadata.get("cv_thresholds") or []],
            sorted((k, float(v)) for k, v in weights.items()),
        )
        return local_table(
            df.sparkSession,
            [row],
            "method string, feature string, direction string, threshold double,"
            " formula string, cv_thresholds array<double>, weights map<string,double>",
        )


def resolve_threshold(limits: Mapping, feature: str, direction: str) -> float | None:
    """The limit for a feature: a number, or the entry for the direction, then
    ``low``, ``high``, ``threshold``. A statistic suffix falls back to its feature."""
    names = [feature] + [feature[: -len(s)] for s in STAT_SUFFIXES if feature.endswith(s)]
    for name in names:
        limit = limits.get(name)
        if limit is None:
            continue
        if not isinstance(limit, Mapping):
            return float(limit)
        for key in (direction, LOW, HIGH, "threshold"):
            if limit.get(key) is not None:
                return float(limit[key])
    return None


def check_training(df: DataFrame, features: Sequence[str], label: str) -> None:
    if not features:
        raise ValueError("no features given")
    require_columns(df, [*features, label], "training frame")
    check_two_classes(df, label)


class Finder:
    """Base of the rule finders: ``fit`` returns a rule and keeps it.

    ``rank_on`` is the same training rows with scaled features: the feature is
    chosen there, while the threshold always comes from ``df`` in raw units.
    """

    method = ""

    def __init__(self, label: str = "label", seed: int = 42):
        self.label = label
        self.seed = seed
        self.rule: Rule | None = None

    def fit(
        self, df: DataFrame, features: Sequence[str], rank_on: DataFrame | None = None
    ) -> Rule:
        raise NotImplementedError

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.rule is None:
            raise RuntimeError("no rule yet; call fit first")
        return self.rule.transform(df, out)

    def describe(self) -> str:
        return "no rule yet; call fit first" if self.rule is None else self.rule.describe()


def _literature(rule_for: str, limits: Mapping, direction: str) -> float:
    found = resolve_threshold(limits, rule_for, direction)
    if found is None:
        raise ValueError(f"no literature threshold for feature {rule_for!r}; have {sorted(limits)}")
    return found


def find_cut(
    df: DataFrame,
    feature: str,
    label: str,
    keys: Sequence[str] | None,
    n_folds: int,
    seed: int,
    negate: bool,
) -> dict:
    """Youden cut of one feature, averaged over validation folds when keys are
    given. ``negate`` looks for low values marking positives."""
    sign = "-" if negate else ""
    slim = df.selectExpr(
        *[q(k) for k in keys or []], f"{sign}CAST({q(feature)} AS DOUBLE) AS __x", f"{q(label)} AS __y"
    )
    if keys:
        placed = folds(slim, n_folds, keys, "__y", seed)
        r = youden_cv(placed, "__x", "__y", "fold").first()
        if r["threshold"] is not None and None not in r["cv_thresholds"]:
            turn = -1.0 if negate else 1.0
            return {
                "threshold": turn * r["threshold"],
                "youden_index": r["youden_index"],
                "optimization": "cv",
                "cv_folds": n_folds,
                "cv_thresholds": [turn * t for t in r["cv_thresholds"]],
                "cv_threshold_std": r["threshold_std"],
            }
        raise ValueError(f"a fold of {feature!r} lacks a class or a finite value; use fewer folds")
    t, j = youden_cut_or_median(slim, "__x", "__y")
    return {"threshold": -t if negate else t, "youden_index": j, "optimization": "single"}


class LiteratureRule(Finder):
    """Strongest logistic coefficient (L2, C = 1), literature threshold, direction
    from the coefficient's sign.

    ``only_with_limit`` considers the features that have a threshold; switched off,
    a winner without one raises ``ValueError``.
    """

    method = "logistic_literature"

    def __init__(self, limits: Mapping, label="label", seed=42, max_iter=1000, only_with_limit=True):
        super().__init__(label, seed)
        self.limits = limits
        self.max_iter = max_iter
        self.only_with_limit = only_with_limit

    def fit(self, df, features, rank_on=None):
        check_training(df, features, self.label)
        model = fit_logistic(df if rank_on is None else rank_on, features, self.label, c=1.0, max_iter=self.max_iter)
        self.rule = self.rule_from(model, features)
        return self.rule

    def rule_from(self, model, features: Sequence[str], limits: Mapping | None = None) -> Rule:
        """The rule of a fitted logistic model; ``limits`` replace the finder's own."""
        limits = self.limits if limits is None else limits
        allowed = list(features)
        if self.only_with_limit:
            allowed = [f for f in features if resolve_threshold(limits, f, HIGH) is not None]
            if not allowed:
                raise ValueError(f"no feature has a literature threshold; have {sorted(limits)}")
        feature = model.strongest(allowed)
        weight = model.weights[feature]
        direction = HIGH if weight > 0 else LOW
        return Rule(
            feature,
            _literature(feature, limits, direction),
            direction,
            self.method,
            metadata={"coefficient": weight, "weights": model.weights, "intercept": model.intercept},
        )


class YoudenRule(Finder):
    """Strongest unpenalised logistic coefficient, threshold with the best Youden
    index, over validation folds when ``keys`` (a unique row key) is given.

    ``direction_aware`` searches the cut for the rule's own direction; switched off,
    high values are always taken as positive.
    """

    method = "logistic_youden"

    def __init__(
        self, keys=None, n_folds=5, label="label", seed=42, max_iter=1000, direction_aware=True
    ):
        super().__init__(label, seed)
        self.keys = list(keys) if keys else None
        self.n_folds = n_folds
        self.max_iter = max_iter
        self.direction_aware = direction_aware

    def fit(self, df, features, rank_on=None):
        check_training(df, features, self.label)
        model = fit_logistic(df if rank_on is None else rank_on, features, self.label, c=None, max_iter=self.max_iter)
        feature, negate = self.choice(model, features)
        cut = find_cut(df, feature, self.label, self.keys, self.n_folds, self.seed, negate)
        self.rule = self.rule_from(model, features, cut)
        return self.rule

    def choice(self, model, features: Sequence[str]) -> tuple[str, bool]:
        """The feature to cut, and whether low values mark positives."""
        feature = model.strongest(features)
        return feature, self.direction_aware and not model.weights[feature] > 0

    def rule_from(self, model, features: Sequence[str], cut: Mapping) -> Rule:
        feature, _ = self.choice(model, features)
        weight = model.weights[feature]
        facts = {k: v for k, v in cut.items() if k != "threshold"}
        return Rule(
            feature, cut["threshold"], HIGH if weight > 0 else LOW, self.method, 4,
            {"coefficient": weight, "weights": model.weights, **facts},
        )


class _AttributionFinder(Finder):
    def __init__(
        self, model="random_forest", settings=None, label="label", seed=42,
        keys=("subject_id",), direction="corr",
    ):
        super().__init__(label, seed)
        self.kind = model
        self.settings = dict(settings or {})
        self.keys = list(keys)
        self.direction_by = direction
        self.model: Fitted | None = None

    def _rank(self, df, features) -> dict:
        check_training(df, features, self.label)
        self.model = fit_model(
            df, features, self.label, self.kind, {"seed": self.seed, **self.settings}
        )
        # a frame of few files would keep most cores idle while trees are attributed
        spread = {} if self.model.kind == "logistic_regression" else {"partitions": df.sparkSession.sparkContext.defaultParallelism}
        return summarise(attribute(self.model, df, self.keys, **spread), features)


class AttributionLiteratureRule(_AttributionFinder):
    """Model, attribution, strongest feature, literature threshold."""

    method = "attribution_literature"

    def __init__(self, limits: Mapping, only_with_limit=True, **kw):
        super().__init__(**kw)
        self.limits = limits
        self.only_with_limit = only_with_limit

    def fit(self, df, features, rank_on=None):
        summary = self._rank(df if rank_on is None else rank_on, features)
        allowed = [
            f for f in features
            if not self.only_with_limit or resolve_threshold(self.limits, f, HIGH) is not None
        ]
        if not allowed:
            raise ValueError(f"no feature has a literature threshold; have {sorted(self.limits)}")
        feature = top_features(summary, 1, allowed)[0]
        direction = direction_of(summary, feature, self.direction_by)
        self.rule = Rule(
            feature, _literature(feature, self.limits, direction), direction, self.method,
            metadata={
                "model": self.kind,
                "importance": summary[feature]["mean_abs"],
                "weights": {f: s["mean_abs"] for f, s in summary.items()},
            },
        )
        return self.rule


class AttributionYoudenRule(_AttributionFinder):
    """Model, attribution, strongest feature, Youden cut (over folds by default)."""

    method = "attribution_youden"

    def __init__(self, n_folds=5, use_cv=True, direction_aware=True, **kw):
        super().__init__(**kw)
        self.n_folds = n_folds
        self.use_cv = use_cv
        self.direction_aware = direction_aware

    def fit(self, df, features, rank_on=None):
        summary = self._rank(df if rank_on is None else rank_on, features)
        feature = top_features(summary, 1)[0]
        direction = direction_of(summary, feature, self.direction_by)
        cut = find_cut(
            df, feature, self.label, self.keys if self.use_cv else None, self.n_folds, self.seed,
            negate=self.direction_aware and direction == LOW,
        )
        self.rule = Rule(
            feature, cut.pop("threshold"), direction, self.method, 4,
            {
                "model": self.kind,
                "importance": summary[feature]["mean_abs"],
                "weights": {f: s["mean_abs"] for f, s in summary.items()},
                **cut,
            },
        )
        return self.rule


# --- flags for every feature -------------------------------------------------


class RangeFlags:
    """``{f}_low``, ``{f}_high``, ``{f}_abnormal`` per feature with a range."""

    def __init__(self, ranges: Mapping[str, Mapping] | None = None):
        self.thresholds: dict[str, dict] = {k: dict(v) for k, v in (ranges or {}).items()}
        self.features: list[str] = []

    def fit(self, df: DataFrame, features: Sequence[str]) -> "RangeFlags":
        require_columns(df, features)
        self.features = [f for f in features if f in self.thresholds]
        return self

    def flag_names(self) -> list[str]:
        return [f"{f}_{s}" for f in self.features for s in ("low", "high", "abnormal")]

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` columns (all by default) plus the 0/1 flags; null stays null."""
        out = []
        for f in self.features:
            lo, hi = self.thresholds[f].get("low"), self.thresholds[f].get("high")
            x = q(f)
            below = "false" if lo is None else f"{x} < {float(lo)!r}D"
            above = "false" if hi is None else f"{x} > {float(hi)!r}D"
            for name, cond in (("low", below), ("high", above), ("abnormal", f"({below} OR {above})")):
                out.append(f"CASE WHEN {x} IS NOT NULL THEN CAST({cond} AS INT) END AS `{f}_{name}`")
        base = ["*"] if keep is None else [q(k) for k in keep]
        return df.selectExpr(*base, *out)


class QuantileFlags(RangeFlags):
    """Range flags with limits learned as percentiles of the data, exact unless
    ``approx``; ``method='optimal'`` learns a Youden cut per feature instead."""

    def __init__(
        self, lower: float = 10.0, upper: float = 90.0, method: str = "percentile",
        label: str = "label", approx: bool = False,
    ):
        super().__init__()
        if method not in ("percentile", "optimal"):
            raise ValueError(f"method must be 'percentile' or 'optimal', not {method!r}")
        self.lower, self.upper = lower, upper
        self.method, self.label, self.approx = method, label, approx

    def fit(self, df, features):
        require_columns(df, features)
        if self.method == "percentile":
            probs = {"low": self.lower / 100.0, "high": self.upper / 100.0}
            self.thresholds = column_quantiles(df, features, probs, self.approx)
        else:
            long = unpivot(df, features, [self.label])
            rows = youden_cut(long, "value", self.label, ["feature"]).collect()
            self.thresholds = {
                r["feature"]: {"low": None, "high": r["threshold"]}
                for r in rows
                if r["threshold"] is not None
            }
        self.features = [f for f in features if f in self.thresholds]
        return self

    def transform(self, df, keep=None):
        if self.method == "percentile":
            return super().transform(df, keep)
        base = ["*"] if keep is None else [q(k) for k in keep]
        return df.selectExpr(
            *base,
            *[
                f"CAST({q(f)} >= {float(self.thresholds[f]['high'])!r}D AS INT) AS `{f}_high`"
                for f in self.features
            ],
        )

    def flag_names(self):
        if self.method == "percentile":
            return super().flag_names()
        return [f"{f}_high" for f in self.features]


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One prediction column per rule, named by its method or position."""
    names = [r.method or f"rule_{i}" for i, r in enumerate(rules)]
    if len(set(names)) != len(names):
        raise ValueError(f"rules need different names to be told apart, found {names}")
    return df.withColumns({n: r.column() for n, r in zip(names, rules)})

