"""Finding, applying and scoring rules, for one cohort and for many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import score_mean
from ..operators.compare import cohort_summary, compare_methods, method_averages, winners
from ..operators.confusion import binary_metrics, class_rates, cut_probability
from ..operators.models import Fitted
from ..operators.prepare import Scaler
from ..operators.ranking import q, qs, text
from ..operators.roc import auc, optimal_threshold, pr_area
from ..operators.split import folds, train_test
from ..operators.thresholds import (
    AttributionLiteratureRule,
    AttributionYoudenRule,
    Finder,
    LiteratureRule,
    RangeFlags,
    Rule,
    YoudenRule,
)
from ..session import stage
from ..sources.config import Config
from ..sources.sinks import write_result
from .grouped_experiments import GROUPED, cross_validate_grouped


def evaluate_rule(
    rule: Rule, df: DataFrame, label: str = "label", by: Sequence[str] = (), extended: bool = False
) -> DataFrame:
    """Metrics of a rule on labelled rows, one row per ``by`` group."""
    scored = rule.transform(df).where(f"prediction IS NOT NULL AND `{label}` IS NOT NULL")
    metrics = binary_metrics(scored, "prediction", label, by, extended)
    return metrics.select(F.lit(rule.method).alias("method"), *metrics.columns)


def evaluate_rules(
    rules: Sequence[Rule], df: DataFrame, label: str = "label", by: Sequence[str] = (),
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics of several rules from one pass: one row per rule and ``by`` group.

    Rows carry ``methods`` (the rules' own names by default), which must differ."""
    if not rules:
        raise ValueError("no rules to evaluate")
    methods = [r.method for r in rules] if methods is None else list(methods)
    if len(set(methods)) != len(rules) or not all(methods):
        raise ValueError(f"rules need different names to be told apart, found {methods}")
    names = [f"__p{i}" for i in range(len(rules))]
    scored = df.select(*by, label, *[r.column().alias(n) for r, n in zip(rules, names)])
    pairs = ", ".join(
        f"struct({text(m)} AS method, {n} AS prediction)" for m, n in zip(methods, names)
    )
    long = scored.selectExpr(*qs([*by, label]), f"inline(array({pairs}))")
    return binary_metrics(long, "prediction", label, ["method", *by])


def evaluate_model(
    model: Fitted, df: DataFrame, label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """Metrics of a classifier: confusion metrics of the probability cut at
    ``threshold``, exact AUC and precision-recall area of the probability."""
    scored = stage(model.predict(df, [label]).where(f"probability IS NOT NULL AND {q(label)} IS NOT NULL"))
    metrics = binary_metrics(
        cut_probability(scored.drop("prediction"), "probability", threshold),
        "prediction", label, extended=True,
    ).drop("auc")
    area = auc(scored, "probability", label).first()
    pr = pr_area(scored, "probability", label).first()
    return metrics.select(
        F.lit(model.kind).alias("method"),
        *metrics.columns,
        F.lit(area["auc"] if area else None).cast("double").alias("auc"),
        F.lit(pr["pr_auc"] if pr else None).cast("double").alias("pr_auc"),
    )


def evaluate_finder(
    finder: Finder,
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "label",
    rank_on: DataFrame | None = None,
) -> tuple[Rule, DataFrame]:
    """Fit on one frame, score on another."""
    rule = finder.fit(train, features, rank_on)
    return rule, evaluate_rule(rule, test, label)


def evaluate_flags(
    flags: RangeFlags,
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "label",
    name: str = "flags",
) -> DataFrame:
    """Score many flag columns together: the score is the mean of a row's flags, a
    row is positive at 0.5 or above. One row with confusion metrics, AUC of the
    score, and its best threshold; a row lacking a feature is not scored."""
    flags.fit(train, features)
    names = flags.flag_names()
    if not names:
        raise ValueError("no feature has a threshold, so there are no flags to score")
    scored = flags.transform(test, [label]).select(label, score_mean(names).alias("score"))
    scored = scored.where(f"score IS NOT NULL AND `{label}` IS NOT NULL")
    metrics = binary_metrics(
        scored.withColumn("prediction", (F.col("score") >= 0.5).cast("int")), "prediction", label
    )
    area = auc(scored, "score", label).first()
    best = optimal_threshold(scored, "score", label).first()
    return metrics.drop("auc").select(
        F.lit(name).alias("method"),
        *[c for c in metrics.columns if c != "auc"],
        F.lit(area["auc"] if area else None).cast("double").alias("auc"),
        F.lit(best["threshold"] if best else None).cast("double").alias("optimal_threshold"),
        F.lit(best["youden_index"] if best else None).cast("double").alias("youden_index"),
    )


def cross_validate(
    make_finder, df: DataFrame, features: Sequence[str], keys: Sequence[str], k: int = 5,
    label: str = "label", seed: int = 42,
) -> DataFrame:
    """Metrics row per fold of rules fitted on the other folds.

    Rules from logistic coefficients are found for all folds together; others fold by fold."""
    if isinstance(make_finder(), GROUPED):
        return cross_validate_grouped(make_finder(), df, features, keys, k, label, seed)
    placed = folds(df, k, keys, label, seed)
    rows = []
    for i in range(k):
        rule = make_finder().fit(placed.where(F.col("fold") != i), features)
        rows.append(
            evaluate_rule(rule, placed.where(F.col("fold") == i), label).withColumn("fold", F.lit(i))
        )
    return compare_methods(rows)


@dataclass(frozen=True)
class Experiment:
    """Outcome for one cohort: rules by method, metrics rows, run facts."""

    cohort: str
    rules: Mapping[str, Rule]
    metrics: DataFrame
    info: Mapping
    predictions: DataFrame

    def winners(self) -> DataFrame:
        first, second = list(self.rules)[:2]
        return winners(self.metrics, first, second, ["cohort"])

    def save(self, path: str) -> dict:
        info = {
            **self.info,
            "cohort": self.cohort,
            "rules": {m: r.formula for m, r in self.rules.items()},
            "time": datetime.now(timezone.utc).isoformat(),
        }
        return write_result(self.metrics, self.predictions, path, info)


def configured_finders(config: Config, cohort: str, keys: Sequence[str] = ("subject_id",), label: str = "label", kind: str | None = None) -> dict[str, Finder]:
    """Literature and Youden finders on attributions of the configured model.

    Model kind, size and seed, and the folds of the cut come from ``config.models``.
    """
    kind, settings = config.model(kind)
    seed = int(settings.pop("seed", 42))
    shared = {"model": kind, "settings": settings, "label": label, "seed": seed, "keys": keys}
    return {
        AttributionLiteratureRule.method: AttributionLiteratureRule(config.thresholds_for(cohort), **shared),
        AttributionYoudenRule.method: AttributionYoudenRule(**config.validation(), **shared),
    }


def run_experiment(
    frame: DataFrame,
    features: Sequence[str],
    cohort: str,
    limits: Mapping,
    keys: Sequence[str] = ("subject_id",),
    label: str = "label",
    test_size: float = 0.3,
    seed: int = 42,
    n_folds: int = 5,
    rank_scaled: bool = True,
    finders: Mapping[str, Finder] | None = None,
) -> Experiment:
    """70/30 stratified split, literature and Youden rules, metrics on the test part.

    ``frame`` holds imputed raw values. With ``rank_scaled`` the features are ranked
    by coefficients of standardised columns, while thresholds and cuts stay in raw
    units.
    """
    train, test = train_test(frame, keys, test_size, label, seed)
    finders = dict(
        finders
        or {
            LiteratureRule.method: LiteratureRule(limits, label, seed),
            YoudenRule.method: YoudenRule(keys, n_folds, label, seed),
        }
    )
    rank_on = None
    if rank_scaled:
        others = [c for c in train.columns if c not in features]
        rank_on = Scaler("standard", others).fit_transform(train)
    rules = {method: finder.fit(train, features, rank_on) for method, finder in finders.items()}
    metrics = compare_methods(evaluate_rules(list(rules.values()), test, label, methods=list(rules)))
    metrics = metrics.withColumn("cohort", F.lit(cohort))
    info = {"seed": seed, **class_rates(frame, label).first().asDict()}
    predictions = test.select(
        *keys, label, *[r.column().alias(m) for m, r in rules.items()]
    )
    return Experiment(cohort, rules, metrics, info, predictions)


def run_cohorts(
    frames: Mapping[str, DataFrame],
    features: Sequence[str],
    limits_of,
    **options,
) -> tuple[dict[str, Experiment], dict[str, str]]:
    """Experiments for several cohorts; a failing cohort is reported, not fatal."""
    done, failed = {}, {}
    for cohort, frame in frames.items():
        try:
            done[cohort] = run_experiment(frame, features, cohort, limits_of(cohort), **options)
        except Exception as error:  # noqa: BLE001  the others go on, whatever it was
            failed[cohort] = f"{type(error).__name__}: {error}"
    return done, failed


def summarise_cohorts(done: Mapping[str, Experiment]) -> tuple[DataFrame, DataFrame]:
    """(one row per cohort with both methods' scores, averages per method)."""
    if not done:
        raise ValueError("no cohort succeeded")
    metrics = compare_methods([e.metrics for e in done.values()])
    methods = list(next(iter(done.values())).rules)
    return cohort_summary(metrics, methods), method_averages(metrics)
