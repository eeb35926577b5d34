"""Confusion counts and the metrics that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_columns
from .ranking import q, qs, text


def confusion(
    df: DataFrame, prediction: str = "prediction", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """(tn, fp, fn, tp) per group, always all four; rows without a label or a
    prediction are not counted."""
    require_columns(df, [*by, prediction, label])
    p, y = q(prediction), q(label)
    return df.groupBy(*by).agg(
        *[
            F.expr(f"count_if({y} = {yv} AND {p} = {pv}) AS {name}")
            for name, yv, pv in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )


def confusion_matrix(df: DataFrame, prediction: str = "prediction", label: str = "label"):
    """``[[tn, fp], [fn, tp]]`` as plain lists."""
    r = confusion(df, prediction, label).first()
    return [[r["tn"], r["fp"]], [r["fn"], r["tp"]]]


_RATIO = "CASE WHEN {b} = 0 THEN 0D ELSE CAST({a} AS DOUBLE) / ({b}) END"
METRICS: Mapping[str, str] = {
    "accuracy": _RATIO.format(a="tp + tn", b="tp + tn + fp + fn"),
    "precision": _RATIO.format(a="tp", b="tp + fp"),
    "recall": _RATIO.format(a="tp", b="tp + fn"),
    "sensitivity": _RATIO.format(a="tp", b="tp + fn"),
    "specificity": _RATIO.format(a="tn", b="tn + fp"),
    "f1": _RATIO.format(a="2 * tp", b="2 * tp + fp + fn"),
}


def with_metrics(counts: DataFrame, extended: bool = False) -> DataFrame:
    """Add accuracy, precision, recall, sensitivity, specificity, F1 and the AUC of
    the binary prediction; ``extended`` adds balanced accuracy and the Matthews
    coefficient. A zero denominator gives 0; the AUC is 0.5 when only one class is
    predicted or present."""
    sens, spec = METRICS["sensitivity"], METRICS["specificity"]
    one_sided = "tp + fp = 0 OR tn + fn = 0 OR tp + fn = 0 OR tn + fp = 0"
    extra = []
    if extended:
        root = " * ".join(
            f"sqrt(CAST({x} AS DOUBLE))" for x in ("tp + fp", "tp + fn", "tn + fp", "tn + fn")
        )
        top = "CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn"
        extra = [
            f"({sens} + {spec}) / 2 AS balanced_accuracy",
            f"CASE WHEN {one_sided} THEN 0D ELSE ({top}) / ({root}) END AS mcc",
        ]
    return counts.selectExpr(
        "*",
        *[f"{e} AS {name}" for name, e in METRICS.items()],
        f"CASE WHEN {one_sided} THEN 0.5D ELSE ({sens} + {spec}) / 2 END AS auc",
        *extra,
    )


def binary_metrics(
    df: DataFrame,
    prediction: str = "prediction",
    label: str = "label",
    by: Sequence[str] = (),
    extended: bool = False,
) -> DataFrame:
    return with_metrics(confusion(df, prediction, label, by), extended)


def cut_probability(df: DataFrame, score: str, threshold: float, out: str = "prediction") -> DataFrame:
    """0/1 prediction of a probability; the cut must lie in [0, 1]."""
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be between 0 and 1, not {threshold}")
    return df.selectExpr("*", f"CAST({q(score)} >= {float(threshold)!r}D AS INT) AS {q(out)}")


def precision_recall(
    df: DataFrame, score: str, label: str = "label", threshold: float | None = None
) -> DataFrame:
    """(precision, recall) of 0/1 predictions, or of scores cut at ``threshold``."""
    if threshold is not None:
        df, score = cut_probability(df, score, threshold, "__cut"), "__cut"
    return binary_metrics(df, score, label).select("precision", "recall")


def flag_metrics(
    df: DataFrame, flags: Sequence[str], label: str = "label", extended: bool = False
) -> DataFrame:
    """Metrics of many 0/1 flag columns against one label, one row per flag, from
    one pass: the flags are unpivoted in the projection and counted map-side."""
    pairs = ", ".join(f"struct({text(f)} AS flag, CAST({q(f)} AS INT) AS __p)" for f in flags)
    long = df.selectExpr(q(label), f"inline(array({pairs}))")
    return with_metrics(confusion(long, "__p", label, ["flag"]), extended)


def class_rates(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, negatives, positive rate and a warning flag under 1 %."""
    return (
        df.groupBy(*by)
        .agg(
            F.expr("count(1) AS n"),
            F.expr(f"count_if({q(label)} = 1) AS positives"),
            F.expr(f"count_if({q(label)} = 0) AS negatives"),
        )
        .selectExpr(
            *qs(list(by)),
            "n",
            "positives",
            "negatives",
            "try_divide(CAST(positives AS DOUBLE), n) AS positive_rate",
            "CAST(coalesce(try_divide(CAST(positives AS DOUBLE), n), 0) < 0.01 AS INT) AS low_rate",
        )
    )
