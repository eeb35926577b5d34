"""Fits, cuts and scores of many groups and folds against single ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import grouped_fits
from cohortspark.operators.compare import compare_methods
from cohortspark.operators.grouped_fits import fit_logistic_groups, optimality
from cohortspark.operators.models import fit_logistic
from cohortspark.operators.split import folds
from cohortspark.operators.thresholds import LiteratureRule, YoudenRule
from cohortspark.plans.experiment import cross_validate, evaluate_rule, run_experiment
from cohortspark.plans.grouped_experiments import grouped_rules, run_cohort_table
from cohortspark.session import stage

from helpers import table

NAMES = ["a", "b", "c"]
LIMITS = {"a": {"low": -0.2, "high": 0.3}, "b": {"low": 4.0, "high": 6.0}, "c": 1.0}


@pytest.fixture(scope="module")
def long(spark):
    """Three cohorts with their own labels, a null one, missing labels, and a cohort of one class."""
    pick = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a, b, c, noise = pick.normal(0, 1), pick.normal(5, 2), float(pick.integers(0, 4)), pick.normal(0, 1)
        labels = {"first": int(a + noise > 0), "second": int(-b + noise < -5), None: int(c + noise > 2), "constant": 1}
        rows += [(i, cohort, a, b, c, None if i % 60 == 7 else label) for cohort, label in labels.items()]
    return stage(spark.createDataFrame(rows, "subject_id long, cohort string, a double, b double, c double, label int"))


def job_count(spark, action):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{id(action)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("c", [1.0, None])
def test_group_fits_equal_single_fits(long, c):
    fits, failed = fit_logistic_groups(long, NAMES, by=["cohort"], c=c)
    assert {f.key[0] for f in fits} == {"first", "second", None} and list(failed) == [(("constant",), None)]
    for fit in fits:
        own = long.where(F.col("cohort").eqNullSafe(fit.key[0]))
        single = fit_logistic(own, NAMES, c=c)
        assert fit.weights == pytest.approx(single.weights, abs=2e-4) and fit.intercept == pytest.approx(single.intercept, abs=1e-3)
        assert fit.residual < 1e-9 and fit.rows == own.where("label IS NOT NULL").count()
        assert optimality(own, NAMES, fit.weights, fit.intercept, c=c).agg(F.max("violation")).first()[0] < 1e-8


def test_scaled_fits_equal_fits_of_scaled_columns(long):
    own = long.where("cohort = 'first'")
    (fit,), _ = fit_logistic_groups(own, NAMES, c=0.1, scaled=True)
    known = own.where("label IS NOT NULL")
    row = known.select(*[F.avg(n).alias(f"m{n}") for n in NAMES], *[F.stddev_pop(n).alias(f"s{n}") for n in NAMES]).first()
    scaled = known.select("label", *[((F.col(n) - row[f"m{n}"]) / row[f"s{n}"]).alias(n) for n in NAMES])
    assert fit.weights == pytest.approx(fit_logistic(scaled, NAMES, c=0.1).weights, abs=1e-4)


def test_folds_are_left_out_in_the_same_scans(spark, long):
    own = long.where("cohort IN ('first', 'second')")
    jobs = {}
    for k in (2, 6):
        placed = stage(folds(own.where("cohort = 'first'"), k, ["subject_id"]))
        jobs[k] = job_count(spark, lambda: fit_logistic_groups(placed, NAMES, leave_out="fold", max_steps=3))
        fits, failed = fit_logistic_groups(placed, NAMES, leave_out="fold")
        assert [f.left_out for f in fits] == list(range(k)) and not failed
        for fit in fits[:2]:
            single = fit_logistic(placed.where(F.col("fold") != fit.left_out), NAMES)
            assert fit.weights == pytest.approx(single.weights, abs=2e-4)
    assert jobs[2] == jobs[6]


def test_separated_classes_end_and_missing_values_raise(spark):
    rows = [(float(i), 1.0, int(i > 9)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    (fit,), _ = fit_logistic_groups(df, ["a", "b"], c=None)
    assert np.isfinite(list(fit.weights.values())).all() and fit.weights["a"] > 1
    with pytest.raises(Exception, match="missing"):
        fit_logistic_groups(df.withColumn("b", F.when(F.col("a") > 3, F.col("b"))), ["a", "b"])
    assert fit_logistic_groups(df.limit(0), ["a"]) == ([], {})
    with pytest.raises(ValueError, match="lacks"):
        fit_logistic_groups(df, ["z"])


def test_a_worse_fit_violates_its_certificate(long):
    own = long.where("cohort = 'first'")
    good = fit_logistic(own, NAMES, l1=True, c=0.05)
    found = {r["feature"]: r for r in optimality(own, NAMES, good.weights, good.intercept, c=0.05, l1=True).collect()}
    assert set(found) == {"", *NAMES} and max(r["violation"] for r in found.values()) < 1e-5
    assert any(r["weight"] == 0 and abs(r["gradient"]) > 1e-4 for r in found.values())
    worse = {**good.weights, "a": good.weights["a"] * 1.01}
    assert optimality(own, NAMES, worse, good.intercept, c=0.05, l1=True).agg(F.max("violation")).first()[0] > 1e-4


def test_cross_validation_equals_fold_by_fold(spark, long):
    own = stage(long.where("cohort = 'first' AND label IS NOT NULL"))
    for make in (YoudenRule, lambda: YoudenRule(["subject_id"], 3), lambda: LiteratureRule(LIMITS)):
        got = {r["fold"]: r.asDict() for r in cross_validate(make, own, NAMES, ["subject_id"], 3).collect()}
        placed = folds(own, 3, ["subject_id"])
        for i in range(3):
            rule = make().fit(placed.where(F.col("fold") != i), NAMES)
            want = compare_methods([evaluate_rule(rule, placed.where(F.col("fold") == i))]).first().asDict()
            assert got[i] == pytest.approx({**want, "fold": i})


def test_cohorts_of_one_table_equal_single_experiments(long):
    run = run_cohort_table(long, NAMES, lambda _: LIMITS, n_folds=3)
    assert set(run.failed) == {"constant"} and {k[0] for k in run.rules} == {"first", "second"}
    got = {(r["cohort"], r["method"]): r.asDict() for r in run.metrics.collect()}
    for cohort in ("first", "second"):
        single = run_experiment(long.where(F.col("cohort") == cohort), NAMES, cohort, LIMITS, n_folds=3)
        for method, rule in single.rules.items():
            mine = run.rules[cohort, method]
            assert (mine.feature, mine.direction) == (rule.feature, rule.direction) and mine.threshold == pytest.approx(rule.threshold)
        for r in single.metrics.collect():
            assert got[cohort, r["method"]] == pytest.approx(r.asDict())


def test_other_finders_are_refused_and_limits_may_lack(long):
    with pytest.raises(TypeError):
        grouped_rules(object(), long, NAMES)
    rules, failed = grouped_rules(LiteratureRule({}), long.where("cohort = 'first'"), NAMES, ["cohort"], limits_of=lambda _: {})
    assert not rules and "literature" in failed[(("first",), None)]


def refitted_order(x, y, names, keep, c=1.0):
    """Backward elimination by plain Newton fits on raw values, one per round."""

    def weights(columns):
        z = np.column_stack([x[:, columns], np.ones(len(y))])
        beta, pull = np.zeros(z.shape[1]), np.append(np.full(len(columns), 1 / c), 0.0)
        for _ in range(60):
            chance = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.solve((z * (chance * (1 - chance))[:, None]).T @ z + np.diag(pull), z.T @ (chance - y) + pull * beta)
        return dict(zip(columns, beta))

    left, gone = list(range(len(names))), []
    while len(left) > keep:
        found = weights(left)
        worst = min(left, key=lambda j: (abs(found[j]), -j))
        left.remove(worst)
        gone.append(worst)
    found = weights(left)
    return [names[j] for j in [*sorted(left, key=lambda j: -abs(found[j])), *gone[::-1]]]


@pytest.mark.parametrize("keep, sums", [(1, None), (3, None), (1, 200)])
def test_elimination_order_equals_refits(spark, monkeypatch, keep, sums):
    # correlated features of different scales: the Gram matrix alone does not foretell every round
    draw = np.random.default_rng(7)
    base = draw.normal(size=(300, 8))
    x = base + 0.9 * base[:, [1, 0, 3, 2, 5, 4, 7, 6]]
    x = x * np.array([1, 3, 1, 0.5, 2, 1, 1, 4])
    y = (base @ np.array([2, -1.5, 1, 1, -0.4, 0.3, 0.2, 0.1]) + draw.normal(size=300) > 0).astype(float)
    names = [f"f{i}" for i in range(8)]
    frame = table(spark, [(*map(float, r), int(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", label int")
    if sums:
        monkeypatch.setattr(grouped_fits, "MOST_SUMS", sums)
    assert grouped_fits.elimination_order(frame, names, keep=keep) == refitted_order(x, y, names, keep)


def test_elimination_shares_its_scans(spark, monkeypatch):
    passes = []
    plain = grouped_fits._sums
    monkeypatch.setattr(grouped_fits, "_sums", lambda rows, models, counted: passes.append(len(models)) or plain(rows, models, counted))
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 12))
    y = (x @ np.linspace(0.1, 2, 12) + draw.normal(size=400) > 0).astype(int)
    names = [f"f{i}" for i in range(12)]
    frame = table(spark, [(*map(float, r), int(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", label int")
    assert grouped_fits.elimination_order(frame, names) == refitted_order(x, y.astype(float), names, 1)
    # eleven refits of about seven steps each would be some eighty passes
    assert len(passes) < 40


def test_elimination_of_little(spark):
    frame = table(spark, [(1.0, 5.0, 0), (2.0, 5.0, 0), (3.0, 5.0, 1), (0.0, 5.0, None)], "a double, b double, label int")
    assert grouped_fits.elimination_order(frame, ["b", "a"]) == ["a", "b"]
    assert grouped_fits.elimination_order(frame, ["a"]) == ["a"] and grouped_fits.elimination_order(frame, []) == []
    with pytest.raises(ValueError):
        grouped_fits.elimination_order(frame.where("label = 1"), ["a"])
    with pytest.raises(ValueError):
        grouped_fits.elimination_order(frame.where("label IS NULL"), ["a"])
