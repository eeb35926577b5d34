"""Comparing rules by their metrics rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import q, text, unpivot

SCORES = ("auc", "f1", "precision", "recall", "sensitivity", "specificity", "accuracy")


def title(metric: str) -> str:
    return metric.replace("_", " ").title()


def compare_methods(rows: Sequence[DataFrame] | DataFrame, titled: bool = False) -> DataFrame:
    """Metrics rows as one table, best AUC first (then by method name)."""
    if not isinstance(rows, DataFrame):
        if not rows:
            raise ValueError("nothing to compare: the list of results is empty")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    if "auc" in rows.columns:
        rows = rows.orderBy(F.col("auc").desc_nulls_last(), F.col("method").asc())
    if titled:
        rows = rows.selectExpr(*[f"{q(c)} AS {q(title(c))}" for c in rows.columns])
    return rows


def winners(
    metrics: DataFrame, first: str, second: str, by: Sequence[str] = (), scores: Sequence[str] = SCORES
) -> DataFrame:
    """Per group and metric: both methods' values and the better one, or ``tie``."""
    long = unpivot(metrics, [s for s in scores if s in metrics.columns], [*by, "method"], "metric")
    return (
        long.groupBy(*by, "metric")
        .agg(
            F.expr(f"max(CASE WHEN method = {text(first)} THEN value END) AS first_value"),
            F.expr(f"max(CASE WHEN method = {text(second)} THEN value END) AS second_value"),
        )
        .selectExpr(
            *[q(b) for b in by],
            "metric",
            "first_value",
            "second_value",
            f"CASE WHEN first_value > second_value THEN {text(first)}"
            f" WHEN second_value > first_value THEN {text(second)} ELSE 'tie' END AS winner",
        )
    )


def cohort_summary(
    metrics: DataFrame,
    methods: Sequence[str],
    scores: Sequence[str] = ("auc", "f1", "sensitivity", "specificity"),
) -> DataFrame:
    """One row per cohort with each method's scores side by side; a method without
    a result for a cohort scores 0 there."""
    return metrics.groupBy("cohort").agg(
        *[
            F.expr(f"coalesce(max(CASE WHEN method = {text(m)} THEN {s} END), 0D) AS `{m}_{s}`")
            for m in methods
            for s in scores
        ]
    )


def method_averages(
    metrics: DataFrame, scores: Sequence[str] = ("auc", "f1", "sensitivity", "specificity")
) -> DataFrame:
    """Mean scores per method over cohorts, with the method of the best mean AUC
    flagged (all of them when tied)."""
    means = metrics.groupBy("method").agg(
        F.expr("count(1) AS cohorts"), *[F.expr(f"avg({s}) AS {s}") for s in scores]
    )
    return means.selectExpr(
        "method", "cohorts", *scores, "auc = max(auc) OVER () AS winner"
    )


def rule_table(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Comparison of rules: feature, threshold, formula, metrics and importance."""
    return metrics.join(rules, "method").selectExpr(
        "method",
        "feature",
        "threshold",
        "formula",
        *[s for s in SCORES if s in metrics.columns],
        "format_string('%.4f', weights[feature]) AS importance",
    )
