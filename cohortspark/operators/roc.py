"""Exact ROC tables, areas and Youden cuts, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_columns
from .ranking import q, qs, quantiles, running_sums


def check_two_classes(df: DataFrame, label: str = "label") -> None:
    """Raise unless ``label`` holds exactly the classes 0 and 1."""
    require_columns(df, [label])
    row = df.selectExpr(
        f"count_if({q(label)} = 1) AS p",
        f"count_if({q(label)} = 0) AS n",
        f"count_if({q(label)} NOT IN (0, 1)) AS other",
    ).first()
    if row["other"]:
        raise ValueError(f"{label} must hold 0 and 1 only")
    if not row["p"] or not row["n"]:
        raise ValueError(f"{label} must hold at least two classes, found {bool(row['p']) + bool(row['n'])}")


def roc_table(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, distinct score): the confusion counts and rates of
    predicting positive at ``score`` or above.

    Columns ``threshold, pos, neg, tp, fp, p_total, n_total, tpr, fpr``. The start
    of the curve (nothing predicted positive) is not a row. Rows without score or
    label are left out; a rate without its class is null.
    """
    by = list(by)
    require_columns(df, [*by, score, label])
    slim = df.selectExpr(*qs(by), f"CAST({q(score)} AS DOUBLE) AS threshold", f"{q(label)} AS __y")
    sums = running_sums(
        slim.where("__y IS NOT NULL"),
        "threshold",
        {"pos": "CAST(__y = 1 AS BIGINT)", "neg": "CAST(__y = 0 AS BIGINT)"},
        by,
        descending=True,
    )
    return sums.selectExpr(
        *qs(by),
        "threshold",
        "pos",
        "neg",
        "pos_before + pos AS tp",
        "neg_before + neg AS fp",
        "pos_total AS p_total",
        "neg_total AS n_total",
        "try_divide(CAST(pos_before + pos AS DOUBLE), pos_total) AS tpr",
        "try_divide(CAST(neg_before + neg AS DOUBLE), neg_total) AS fpr",
    )


def auc_from_roc(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve as the rank sum, which equals the trapezoid area."""
    return (
        roc.groupBy(*by)
        .agg(
            F.expr("sum(CAST(neg AS DOUBLE) * (tp - pos + pos / 2D)) AS __s"),
            F.expr("CAST(max(p_total) AS DOUBLE) * max(n_total) AS __pn"),
        )
        .selectExpr(*qs(list(by)), "try_divide(__s, __pn) AS auc")
    )


def auc(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Exact AUC per group; null for a group with one class."""
    return auc_from_roc(roc_table(df, score, label, by), by)


def auc_value(df: DataFrame, score: str = "score", label: str = "label") -> float:
    """AUC of one table as a number; one class raises ``ValueError``."""
    check_two_classes(df, label)
    return auc(df, score, label).first()["auc"]


def youden_from_roc(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The finite threshold with the largest TPR - FPR, the highest on a tie."""
    best = (
        "max(CASE WHEN abs(threshold) < double('Infinity') THEN"
        " struct(tpr - fpr AS j, threshold AS t, tpr, fpr) END)"
    )
    return (
        roc.groupBy(*by)
        .agg(F.expr(f"{best} AS __b"))
        .selectExpr(
            *qs(list(by)),
            "__b.t AS threshold",
            "__b.j AS youden_index",
            "__b.tpr AS sensitivity",
            "1 - __b.fpr AS specificity",
        )
    )


def youden_cut(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Threshold with the best Youden index per group, null without a finite one."""
    return youden_from_roc(roc_table(df, score, label, by), by)


def youden_cut_or_median(
    df: DataFrame, score: str = "score", label: str = "label"
) -> tuple[float, float]:
    """(threshold, index) of one table, with the median as the last resort."""
    found = youden_cut(df, score, label).first()
    if found is not None and found["threshold"] is not None:
        return found["threshold"], found["youden_index"]
    middle = quantiles(df, score, {"m": 0.5}).first()
    t = middle["m"] if middle is not None else None
    if t is None:
        raise ValueError(f"{score} has no values")
    row = df.selectExpr(
        f"avg(CASE WHEN {q(label)} = 1 THEN CAST({q(score)} >= double('{t!r}') AS INT) END) AS tpr",
        f"avg(CASE WHEN {q(label)} = 0 THEN CAST({q(score)} >= double('{t!r}') AS INT) END) AS fpr",
    ).first()
    return t, (row["tpr"] or 0.0) - (row["fpr"] or 0.0)


def optimal_threshold(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    metric: str = "youden",
) -> DataFrame:
    """As ``youden_cut``, but the start of the curve competes: when no threshold has
    a positive index the row is (null, 0, 0, 1), predicting nothing positive."""
    if metric != "youden":
        raise ValueError(f"unsupported metric {metric!r}; only 'youden' is supported")
    cut = youden_cut(df, score, label, by)
    return cut.selectExpr(
        *qs(list(by)),
        "CASE WHEN youden_index > 0 THEN threshold END AS threshold",
        "CASE WHEN youden_index IS NOT NULL THEN greatest(youden_index, 0D) END AS youden_index",
        "CASE WHEN youden_index > 0 THEN sensitivity WHEN youden_index IS NOT NULL THEN 0D END AS sensitivity",
        "CASE WHEN youden_index > 0 THEN specificity WHEN youden_index IS NOT NULL THEN 1D END AS specificity",
    )


def youden_cv(
    df: DataFrame, score: str, label: str = "label", fold: str = "fold", by: Sequence[str] = ()
) -> DataFrame:
    """Cut on every fold in one job, then mean threshold, mean index, population
    deviation and the thresholds in fold order (per ``by`` group)."""
    by = list(by)
    cuts = youden_cut(df, score, label, [*by, fold])
    return cuts.groupBy(*by).agg(
        F.expr("avg(threshold) AS threshold"),
        F.expr("avg(youden_index) AS youden_index"),
        F.expr("stddev_pop(threshold) AS threshold_std"),
        F.expr("count(1) AS n_folds"),
        F.expr(
            f"transform(array_sort(collect_list(struct({q(fold)} AS f, threshold AS t))), x -> x.t)"
            " AS cv_thresholds"
        ),
    )


def pr_table(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Precision and recall at every threshold, and the positive share."""
    return roc_table(df, score, label, by).selectExpr(
        *qs(list(by)),
        "threshold",
        "CAST(tp AS DOUBLE) / (tp + fp) AS precision",
        "tpr AS recall",
        "CAST(p_total AS DOUBLE) / (p_total + n_total) AS baseline",
        "pos",
        "tp",
        "fp",
        "p_total",
    )


def pr_area(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Trapezoid area under precision over recall, starting at (recall 0, precision
    1), and the positive share.

    The width of a trapezoid is the row's own positives over all positives, and the
    precision before the row follows from its own counts, so no neighbour row is
    needed and the sum runs over any partitioning.
    """
    before = (
        "CASE WHEN tp - pos + fp - neg = 0 THEN 1D"
        " ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END"
    )
    return (
        roc_table(df, score, label, by)
        .groupBy(*by)
        .agg(
            F.expr(
                f"sum(try_divide(CAST(pos AS DOUBLE), p_total) * (CAST(tp AS DOUBLE) / (tp + fp) + {before}) / 2)"
                " AS pr_auc"
            ),
            F.expr("CAST(max(p_total) AS DOUBLE) / (max(p_total) + max(n_total)) AS baseline"),
        )
    )
