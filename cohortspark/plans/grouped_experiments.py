"""Rules of many cohorts and folds, found, cut and scored by jobs that all of them share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import compare_methods
from ..operators.confusion import binary_metrics
from ..operators.grouped_fits import fit_logistic_groups
from ..operators.ranking import q, qs, text
from ..operators.roc import youden_cut, youden_cv
from ..operators.split import Splitter, folds
from ..operators.thresholds import Finder, LiteratureRule, Rule, YoudenRule
from ..session import local_table, null_safe, require_columns, stage

# Finders whose features come from logistic coefficients, which can be fitted together.
GROUPED = (LiteratureRule, YoudenRule)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _model_rows(df: DataFrame, wanted: list, features: Sequence[str], label: str, keys, by, leave_out) -> DataFrame:
    """(model, score, label, *keys): each row once for every model that learns from it."""
    x = f"array({', '.join(f'CAST({q(f)} AS DOUBLE)' for f in features)})"
    rows = df.selectExpr(*qs(list(keys)), *qs(list(by)), *([q(leave_out)] if leave_out else []), f"{q(label)} AS __y", f"{x} AS __x")
    if by:
        schema = ", ".join(f"{q(k)} {_kind(df, k)}" for k in by)
        schema += ", __model int, __place int, __sign double" + (f", __out {_kind(df, leave_out)}" if leave_out else "")
        table = [(*fit.key, i, place, sign, *([fit.left_out] if leave_out else [])) for i, fit, place, sign in wanted]
        met = null_safe(rows, local_table(df.sparkSession, table, schema), list(by))
    else:
        pieces = [
            f"struct({i} AS __model, {place} AS __place, {sign!r}D AS __sign" + (f", CAST({text(str(fit.left_out))} AS {_kind(df, leave_out)}) AS __out)" if leave_out else ")")
            for i, fit, place, sign in wanted
        ]
        met = rows.selectExpr("*", f"inline(array({', '.join(pieces)}))")
    if leave_out:
        met = met.where(f"{q(leave_out)} <> __out")
    return met.selectExpr("__model", "__sign * __x[__place] AS __score", "__y", *qs(list(keys)))


def _cuts(finder: YoudenRule, rows: DataFrame, signs: Mapping[int, float]) -> dict[int, dict]:
    """The Youden cut of every model from one job, over validation folds if the finder has keys."""
    if not finder.keys:
        found = youden_cut(rows, "__score", "__y", ["__model"]).collect()
        return {
            r["__model"]: {"threshold": signs[r["__model"]] * r["threshold"], "youden_index": r["youden_index"], "optimization": "single"}
            for r in found if r["threshold"] is not None
        }
    strata = rows.withColumn("__stratum", F.concat(F.col("__model").cast("string"), F.lit("|"), F.col("__y").cast("string")))
    placed = folds(stage(strata), finder.n_folds, finder.keys, "__stratum", finder.seed)
    out = {}
    for r in youden_cv(placed, "__score", "__y", "fold", ["__model"]).collect():
        if r["threshold"] is not None and None not in r["cv_thresholds"]:
            sign = signs[r["__model"]]
            out[r["__model"]] = {
                "threshold": sign * r["threshold"], "youden_index": r["youden_index"], "optimization": "cv", "cv_folds": finder.n_folds,
                "cv_thresholds": [sign * t for t in r["cv_thresholds"]], "cv_threshold_std": r["threshold_std"],
            }
    return out


def grouped_rules(
    finder: Finder, df: DataFrame, features: Sequence[str], by: Sequence[str] = (), leave_out: str | None = None,
    limits_of=None, scaled: bool = False,
) -> tuple[dict[tuple, Rule], dict[tuple, str]]:
    """The finder's rule for every (group key, fold left out), and why others have none.

    One grouped fit and, for cuts, one ROC job serve all. ``limits_of(*key)`` gives a group's literature limits;
    ``scaled`` ranks features in units of the model's own deviations, while cuts stay raw.
    """
    if not isinstance(finder, GROUPED):
        raise TypeError(f"{type(finder).__name__} is not found from logistic coefficients")
    literature = isinstance(finder, LiteratureRule)
    fits, failed = fit_logistic_groups(
        df, features, finder.label, by, leave_out, 1.0 if literature else None, scaled
    )
    rules, wanted = {}, []
    for i, fit in enumerate(fits):
        name = (fit.key, fit.left_out)
        if not literature:
            feature, negate = finder.choice(fit, features)
            wanted.append((i, fit, list(features).index(feature), -1.0 if negate else 1.0))
            continue
        try:
            rules[name] = finder.rule_from(fit, features, limits_of(*fit.key) if limits_of else None)
        except ValueError as error:
            failed[name] = str(error)
    if wanted:
        rows = _model_rows(df, wanted, features, finder.label, finder.keys or [], by, leave_out)
        cuts = _cuts(finder, rows.where("__y IS NOT NULL"), {i: sign for i, _, _, sign in wanted})
        for i, fit, place, _ in wanted:
            if i in cuts:
                rules[(fit.key, fit.left_out)] = finder.rule_from(fit, features, cuts[i])
            else:
                failed[(fit.key, fit.left_out)] = f"no finite cut of {features[place]!r} in every fold"
    return rules, failed


def score_grouped(
    rules: Sequence[tuple[tuple, str, Rule]], df: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label"
) -> DataFrame:
    """Metrics by method and ``keys`` of (key, method, rule), each on the rows of its own key, in one pass."""
    schema = ", ".join(f"{q(k)} {_kind(df, k)}" for k in keys) + ", method string, __place int, __cut double, __high boolean"
    table = [(*key, method, list(features).index(rule.feature), float(rule.threshold), rule.direction == "high") for key, method, rule in rules]
    x = f"array({', '.join(f'CAST({q(f)} AS DOUBLE)' for f in features)})"
    rows = df.where(f"{q(label)} IS NOT NULL").selectExpr(*qs([*keys, label]), f"{x} AS __x")
    met = null_safe(rows, local_table(df.sparkSession, table, schema), list(keys)).selectExpr("*", "__x[__place] AS __v")
    scored = met.where("__v IS NOT NULL").selectExpr(
        "method", *qs([*keys, label]), "CAST(IF(__high, __v >= __cut, __v <= __cut) AS INT) AS prediction"
    )
    return binary_metrics(scored, "prediction", label, ["method", *keys])


def cross_validate_grouped(
    finder: Finder, df: DataFrame, features: Sequence[str], keys: Sequence[str], k: int = 5, label: str = "label", seed: int = 42
) -> DataFrame:
    """Metrics row per fold of rules fitted on the other folds; jobs do not depend on ``k``."""
    placed = stage(folds(df, k, keys, label, seed))
    rules, failed = grouped_rules(finder, placed, features, leave_out="fold")
    if failed:
        raise ValueError(f"no rule for some folds: {failed}")
    return compare_methods(score_grouped([((fold,), r.method, r) for (_, fold), r in rules.items()], placed, features, ["fold"], label))


@dataclass(frozen=True)
class CohortRuns:
    """Outcome for all cohorts: metrics by method and cohort, rules, failures by cohort, and the marked rows."""

    metrics: DataFrame | None
    rules: Mapping[tuple[str, str], Rule]
    failed: Mapping[str, str]
    parts: DataFrame


def run_cohort_table(
    frame: DataFrame,
    features: Sequence[str],
    limits_of,
    cohort: str = "cohort",
    keys: Sequence[str] = ("subject_id",),
    label: str = "label",
    test_size: float = 0.3,
    seed: int = 42,
    n_folds: int = 5,
    rank_scaled: bool = True,
) -> CohortRuns:
    """``run_experiment`` for every cohort of one long frame (a row per subject and cohort).

    The split, the fits, the cuts and the scores of all cohorts share their jobs. A cohort without a class or a
    threshold is reported in ``failed`` and the others go on; a cohort counts as failed if one of its two methods has no rule.
    """
    require_columns(frame, [*features, label, cohort, *keys], "cohort frame")
    strata = frame.where(f"{q(cohort)} IS NOT NULL").withColumn(
        "__stratum", F.concat(F.col(cohort).cast("string"), F.lit("|"), F.col(label).cast("string"))
    )
    marked = stage(Splitter(test_size, 0.0).stratified(strata, "__stratum", list(keys), seed).drop("__stratum"))
    train, test = marked.where("split = 'train'"), marked.where("split = 'test'")
    found, failed = {}, {}
    for finder in (LiteratureRule({}, label, seed), YoudenRule(list(keys), n_folds, label, seed)):
        rules, why = grouped_rules(finder, train, features, [cohort], limits_of=limits_of, scaled=rank_scaled)
        found.update({(key[0], finder.method): rule for (key, _), rule in rules.items()})
        failed.update({key[0]: reason for (key, _), reason in why.items()})
    known = {name for name, _ in found}
    rules = {k: r for k, r in found.items() if k[0] not in failed}
    failed = {name: failed.get(name, "no rule") for name in {*failed, *(known - {n for n, _ in rules})}}
    metrics = None
    if rules:
        metrics = compare_methods(score_grouped([((name,), m, r) for (name, m), r in rules.items()], test, features, [cohort], label))
    return CohortRuns(metrics, rules, failed, marked)
