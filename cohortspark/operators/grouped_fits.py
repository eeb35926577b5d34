"""Logistic fits of many groups and folds from the same scans.

All models take their Newton steps together. A step is one job: every task sums, for each model whose rows it
holds, the loss, the gradient and the packed upper half of the weighted Gram matrix; these sums are added
in one grouping by (model, position), and the driver solves one small system per model. A row counts for
the models of its group that do not leave its fold out, so folds and cohorts cost no scan of
their own. What reaches the driver is bounded by models times squared features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table, null_safe, require_columns, stage
from .ranking import q, qs

# Doubles that one step may send to the driver.
MOST_SUMS = 20_000_000
SMALLEST_STEP = 2.0**-20


@dataclass(frozen=True)
class GroupFit:
    """One model: its group's key, the fold left out, and coefficients by feature."""

    key: tuple
    left_out: object
    weights: Mapping[str, float]
    intercept: float
    rows: int
    residual: float

    def strongest(self, among: Sequence[str]) -> str:
        """Largest absolute weight; the earliest feature on a tie."""
        names = list(self.weights)
        return max(among, key=lambda f: (abs(self.weights[f]), -names.index(f)))


class _Model:
    """The state of one fit, in standardised units. Coefficients outside ``active`` stay 0."""

    def __init__(self, key, left_out, count, mean, sd, penalty, active=None, start=None):
        self.key, self.left_out, self.count = key, left_out, count
        self.mean, self.sd, self.penalty = mean, sd, penalty
        self.active = np.arange(len(mean) + 1) if active is None else active
        self.beta = np.zeros(len(mean) + 1)
        self.tried = self.beta if start is None else start
        self.loss, self.step, self.size, self.gram = np.inf, None, 1.0, None
        self.done, self.residual = False, np.inf

    def advance(self, sums: np.ndarray, tolerance: float) -> None:
        """Take the sums at ``tried``: keep it and plan a step, or halve the last step."""
        m = len(self.beta)
        weight = np.append(self.penalty, 0.0)
        loss = sums[0] + 0.5 * float(weight @ self.tried**2)
        if not loss <= self.loss + 1e-12 * abs(self.loss) and np.isfinite(self.loss):
            self.size /= 2
            self.done = self.size < SMALLEST_STEP
            self.tried = self.beta + self.size * self.step
            return
        better = self.loss - loss
        self.beta, self.loss, self.size = self.tried, loss, 1.0
        gradient = (sums[1 : m + 1] + weight * self.beta)[self.active]
        gram = np.zeros((m, m))
        gram[np.triu_indices(m)] = sums[m + 1 :]
        gram = gram + np.triu(gram, 1).T + np.diag(weight)
        gram[np.diag_indices(m)] += 1e-12 * (1.0 + np.trace(gram) / m)
        self.gram = gram[np.ix_(self.active, self.active)]
        self.residual = float(np.abs(gradient).max() / self.count)
        if self.residual < tolerance or better <= 1e-14 * abs(loss):
            self.done = True
            return
        self.step = np.zeros(m)
        self.step[self.active] = np.linalg.lstsq(self.gram, -gradient, rcond=None)[0]
        self.tried = self.beta + self.step

    def fit(self, features, scaled: bool) -> GroupFit:
        weights, intercept = self.beta[:-1], float(self.beta[-1])
        if not scaled:
            weights = weights / self.sd
            intercept -= float(weights @ self.mean)
        return GroupFit(self.key, self.left_out, dict(zip(features, weights.tolist())), intercept, self.count, self.residual)


def _cells(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> list:
    """Count, positives, means and deviations of every (group, fold), from one pass."""
    return df.groupBy(*keys).agg(
        F.expr("count(1) AS rows"), F.expr("sum(y) AS positives"),
        *[F.expr(f"avg(x[{i}]) AS a{i}") for i in range(len(features))],
        *[F.expr(f"var_pop(x[{i}]) AS v{i}") for i in range(len(features))],
    ).collect()


def _merged(cells: list, p: int) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows, positives, means and population deviations of several cells together."""
    n = np.array([c["rows"] for c in cells], float)
    means = np.array([[c[f"a{i}"] for i in range(p)] for c in cells])
    spreads = np.array([[c[f"v{i}"] for i in range(p)] for c in cells])
    mean = n @ means / n.sum()
    variance = n @ (spreads + (means - mean) ** 2) / n.sum()
    sd = np.sqrt(np.maximum(variance, 0.0))
    # Rounding leaves a tiny spread on a constant column.
    sd[sd <= 1e-12 * np.abs(mean)] = 1.0
    return int(n.sum()), sum(c["positives"] for c in cells), mean, np.where(sd == 0, 1.0, sd)


def _sums(rows: DataFrame, models: list[_Model], counted: np.ndarray) -> dict[int, np.ndarray]:
    """Loss, gradient and packed Gram matrix of each unfinished model at its tried coefficients."""
    live = [(j, m.tried, m.mean, m.sd) for j, m in enumerate(models) if not m.done]
    p = len(models[0].mean)
    upper = np.triu_indices(p + 1)

    def run(batches):
        total = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            for j, beta, mean, sd in live:
                mine = counted[j][cell]
                if not mine.any():
                    continue
                z = np.column_stack([(x[mine] - mean) / sd, np.ones(int(mine.sum()))])
                margin, target = z @ beta, y[mine]
                chance = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                gram = (z * (chance * (1 - chance))[:, None]).T @ z
                loss = float((np.logaddexp(0.0, margin) - target * margin).sum())
                part = np.concatenate([[loss], z.T @ (chance - target), gram[upper]])
                total[j] = total[j] + part if j in total else part
        if total:
            ids = np.repeat(np.array(list(total), np.int32), [len(v) for v in total.values()])
            places = np.concatenate([np.arange(len(v), dtype=np.int32) for v in total.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(places), pa.array(np.concatenate(list(total.values())))], ["model", "place", "value"]
            )

    found = (
        rows.mapInArrow(run, "model int, place int, value double")
        .groupBy("model", "place").agg(F.sum("value").alias("value")).toArrow()
    )
    out = {j: np.zeros(1 + (p + 1) + len(upper[0])) for j, *_ in live}
    for j, at, value in zip(*[found.column(c).to_numpy() for c in ("model", "place", "value")]):
        out[j][at] = value
    return out


def _rows(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Staged (keys, y, x) of the rows with a label."""
    values = ", ".join(f"CAST({q(f)} AS DOUBLE)" for f in features)
    complete = (
        f"if(exists(array({values}), v -> v IS NULL OR isnan(v)),"
        f" raise_error('a feature value is missing; impute first'), array({values})) AS x"
    )
    known = df.where(f"{q(label)} IS NOT NULL").selectExpr(*qs(keys), f"CAST({q(label)} AS DOUBLE) AS y", complete)
    return stage(known)


def _run(rows: DataFrame, models: list[_Model], counted: np.ndarray, max_steps: int, tolerance: float) -> None:
    """Newton steps of all models together until each is done."""
    for _ in range(max_steps):
        if all(m.done for m in models):
            break
        for j, sums in _sums(rows, models, counted).items():
            models[j].advance(sums, tolerance)


def fit_logistic_groups(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    by: Sequence[str] = (),
    leave_out: str | None = None,
    c: float | None = 1.0,
    scaled: bool = False,
    max_steps: int = 60,
    tolerance: float = 1e-10,
) -> tuple[list[GroupFit], dict[tuple, str]]:
    """A logistic fit per ``by`` group and, with ``leave_out``, per fold on the group's other folds.

    ``c`` is the inverse L2 penalty of the summed loss (None: no penalty). With ``scaled`` features are standardised
    by the model's own rows and the weights stay in these units; else both are those of raw values. Rows without a
    label take no part, a missing feature fails the job. Also returns, for models that cannot be
    fitted, (key, fold) and why: a class or all rows are missing. The number of jobs depends on the steps only.
    """
    require_columns(df, [*features, label, *by, *([leave_out] if leave_out else [])], "training frame")
    keys = [*by, *([leave_out] if leave_out else [])]
    rows = _rows(df, features, label, keys)
    p = len(features)
    cells = [cell for cell in _cells(rows, features, keys) if cell["rows"]]
    models, failed = [], {}
    groups = {}
    for cell in cells:
        groups.setdefault(tuple(cell[k] for k in by), []).append(cell)
    for key, own in groups.items():
        for out in sorted({cell[leave_out] for cell in own}) if leave_out else [None]:
            kept = [cell for cell in own if leave_out is None or cell[leave_out] != out]
            if not kept:
                failed[(key, out)] = "no rows are left"
                continue
            count, positives, mean, sd = _merged(kept, p)
            if not 0 < positives < count:
                failed[(key, out)] = "both classes are needed"
                continue
            penalty = np.zeros(p) if c is None else (1.0 / c) / (np.ones(p) if scaled else sd**2)
            models.append(_Model(key, out, count, mean, sd, penalty))
    if not models:
        return [], failed
    if len(models) * (p + 2) * (p + 3) / 2 > MOST_SUMS:
        raise ValueError(f"{len(models)} models of {p} features are too many for one pass; fit them in parts")
    order = {tuple(cell[k] for k in keys): i for i, cell in enumerate(cells)}
    counted = np.array([
        [tuple(cell[k] for k in by) == m.key and (leave_out is None or cell[leave_out] != m.left_out) for cell in cells]
        for m in models
    ])
    if keys:
        schema = ", ".join(f"{q(k)} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", cell int"
        table = local_table(df.sparkSession, [(*k, i) for k, i in order.items()], schema)
        rows = stage(null_safe(rows, table, keys).select("cell", "x", "y"))
    else:
        rows = rows.selectExpr("0 AS cell", "x", "y")
    _run(rows, models, counted, max_steps, tolerance)
    return [m.fit(features, scaled) for m in models], failed


def elimination_order(
    df: DataFrame, features: Sequence[str], label: str = "label", keep: int = 1, c: float | None = 1.0,
    max_steps: int = 60, tolerance: float = 1e-10,
) -> list[str]:
    """Features from strongest to first eliminated, where in each round the least absolute coefficient of a fit on the
    remaining features leaves, the later one of equals; the last ``keep`` are ordered by their fit.

    The result is that of one refit per round, without its jobs. The Gram matrix at a fit's optimum foretells all later
    rounds (sweeping a feature out of its inverse gives the coefficients of the rest to second order). The
    nested models foretold are then fitted in shared scans, from the foretold coefficients. Where a fit names another
    feature than foretold, the models before it stand and its own Gram matrix foretells the rest anew. A pass takes as
    many nested models as their sums may reach the driver.
    """
    require_columns(df, [*features, label], "training frame")
    p, keep = len(features), max(1, keep)
    if not features:
        return []
    rows = _rows(df, features, label, [])
    cells = [cell for cell in _cells(rows, features, []) if cell["rows"]]
    if not cells:
        raise ValueError("no labelled rows to fit")
    count, positives, mean, sd = _merged(cells, p)
    if not 0 < positives < count:
        raise ValueError("both classes are needed")
    penalty = np.zeros(p) if c is None else (1.0 / c) / sd**2
    rows = rows.selectExpr("0 AS cell", "x", "y")
    at_once = max(1, int(MOST_SUMS / ((p + 2) * (p + 3) / 2)))

    def weakest(active, beta):
        return min(active[:-1], key=lambda j: (abs(beta[j] / sd[j]), -j))

    def fitted(models):
        _run(rows, models, np.ones((len(models), 1), bool), max_steps, tolerance)
        return models

    (at,) = fitted([_Model((), None, count, mean, sd, penalty)])
    gone = []
    while len(at.active) - 1 > keep:
        active, beta, inverse = at.active, at.beta.copy(), np.linalg.inv(at.gram)
        foretold, nested = [], []
        while len(active) - 1 > keep and len(nested) < at_once:
            out = weakest(active, beta)
            i = int(np.flatnonzero(active == out)[0])
            column = inverse[:, i] / inverse[i, i]
            beta[active] -= column * beta[out]
            beta[out] = 0.0
            inverse = np.delete(np.delete(inverse - np.outer(column, inverse[i]), i, 0), i, 1)
            active = np.delete(active, i)
            foretold.append(out)
            nested.append(_Model((), None, count, mean, sd, penalty, active, beta.copy()))
        for model, out in zip(fitted(nested), foretold):
            if weakest(at.active, at.beta) != out:
                break
            gone.append(out)
            at = model
    left = sorted(at.active[:-1].tolist(), key=lambda j: -abs(at.beta[j] / sd[j]))
    return [features[j] for j in [*left, *gone[::-1]]]


def optimality(
    df: DataFrame, features: Sequence[str], weights: Mapping[str, float], intercept: float,
    label: str = "label", c: float | None = 1.0, l1: bool = False,
) -> DataFrame:
    """(feature, weight, gradient, violation): how far a logistic fit is from its optimum, from one pass.

    ``gradient`` is the derivative of the mean loss. At the optimum it balances the penalty: ``violation`` is the
    distance of the gradient from minus the penalty's derivative (L2, none) or from the
    penalty's subdifferential (L1), over the mean absolute feature value. The intercept has the empty name.
    As the loss is convex, no violation means no better coefficients exist.
    """
    known = df.where(f"{q(label)} IS NOT NULL")
    margin = " + ".join([f"{float(intercept)!r}D", *[f"{float(weights[f])!r}D * {q(f)}" for f in features]])
    error = f"(1 / (1 + exp(-({margin}))) - {q(label)})"
    sums = known.selectExpr(f"{error} AS e", *[f"CAST({q(f)} AS DOUBLE) AS x{i}" for i, f in enumerate(features)]).selectExpr(
        "count(1) AS n", "avg(e) AS g", *[f"avg(e * x{i}) AS g{i}" for i in range(len(features))],
        *[f"avg(abs(x{i})) AS s{i}" for i in range(len(features))],
    )
    pieces = ["struct('' AS feature, %rD AS weight, g AS gradient, 1D AS size)" % float(intercept)]
    pieces += [
        f"struct('{f}' AS feature, {float(weights[f])!r}D AS weight, g{i} AS gradient, s{i} AS size)" for i, f in enumerate(features)
    ]
    rate = "0D" if c is None else f"{1.0 / c!r}D / n"
    pull = f"weight * {rate}"
    if l1:
        pull = f"CASE WHEN weight = 0 THEN -sign(gradient) * least(abs(gradient), {rate}) ELSE sign(weight) * {rate} END"
    pull = f"CASE WHEN feature = '' THEN 0D ELSE {pull} END"
    return sums.selectExpr("n", f"inline(array({', '.join(pieces)}))").selectExpr(
        "feature", "weight", "gradient", f"abs(gradient + {pull}) / greatest(size, 1e-300D) AS violation"
    )
