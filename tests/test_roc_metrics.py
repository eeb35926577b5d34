"""ROC, cuts, confusion metrics and comparisons."""

import pytest

from cohortspark.operators import roc
from cohortspark.operators.compare import cohort_summary, compare_methods, method_averages, rule_table, winners
from cohortspark.operators.confusion import (
    binary_metrics,
    class_rates,
    confusion_matrix,
    cut_probability,
    flag_metrics,
    precision_recall,
)
from cohortspark.operators.thresholds import Rule

from helpers import lcg, plan, table

SCORED = "label int, score double"
PERFECT = [(0, 0.1), (0, 0.2), (0, 0.15), (1, 0.85), (1, 0.9), (1, 0.95)]
MIXED = list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]))


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_perfect_separation(spark):
    df = table(spark, PERFECT, SCORED)
    assert roc.auc_value(df) == 1.0
    best = roc.youden_cut(df).first()
    assert (best["threshold"], best["youden_index"], best["sensitivity"], best["specificity"]) == (0.85, 1, 1, 1)
    assert roc.pr_area(df).first()["pr_auc"] == 1.0


def test_auc_with_ties_matches_pairs(spark):
    rows = [(int(a > 0.6), round(b * 8) / 8) for a, b in zip(lcg(400, 2), lcg(400, 7))] + [(1, 0.5)] * 150
    df = table(spark, rows, SCORED)
    assert roc.auc_value(df) == pytest.approx(brute_auc(rows), abs=1e-12)
    flipped = df.selectExpr("label", "-score AS score")
    assert roc.auc_value(flipped) == pytest.approx(1 - brute_auc(rows), abs=1e-12)
    rates = [(r["tpr"], r["fpr"]) for r in roc.roc_table(df).orderBy("threshold").collect()]
    assert rates == sorted(rates, reverse=True)


def test_index_identity_and_groups(spark):
    df = table(spark, MIXED, SCORED).selectExpr("*", "label AS g0").selectExpr("label", "score", "'x' AS g")
    r = roc.optimal_threshold(df, by=["g"]).first()
    assert r["youden_index"] == pytest.approx(r["sensitivity"] + r["specificity"] - 1)


def test_no_threshold_beats_chance(spark):
    df = table(spark, [(1, 1.0), (0, 2.0), (0, 3.0)], SCORED)
    start = roc.optimal_threshold(df).first()
    assert (start["threshold"], start["youden_index"], start["specificity"]) == (None, 0.0, 1.0)
    # among finite thresholds the lowest accepts everything: index 0
    assert roc.youden_cut(df).first()["threshold"] == 1.0
    with pytest.raises(ValueError, match="unsupported"):
        roc.optimal_threshold(df, metric="f1")


def test_infinite_scores_fall_back_to_the_median(spark):
    df = table(spark, [(1, float("inf")), (0, float("inf"))], SCORED)
    assert roc.youden_cut(df).first()["threshold"] is None
    t, j = roc.youden_cut_or_median(df)
    assert t == float("inf") and j == 0.0


def test_one_class(spark):
    df = table(spark, [(1, 0.3), (1, 0.4)], SCORED)
    with pytest.raises(ValueError, match="two classes"):
        roc.auc_value(df)
    assert roc.auc(df).first()["auc"] is None
    assert roc.pr_area(df.selectExpr("0 AS label", "score")).first()["pr_auc"] is None
    assert class_rates(df.where("label = 7")).first()["low_rate"] == 1
    with pytest.raises(ValueError, match="0 and 1"):
        roc.check_two_classes(table(spark, [(2, 0.0)], SCORED))


def test_cv_cut(spark):
    rows = [(y, s, f) for f in (0, 1) for y, s in PERFECT]
    rows[9] = (1, 0.8, 1)
    df = table(spark, rows, "label int, score double, fold int")
    r = roc.youden_cv(df, "score").first()
    assert r["cv_thresholds"] == [0.85, 0.8]
    assert r["threshold"] == pytest.approx(0.825) and r["threshold_std"] == pytest.approx(0.025)


def test_roc_plan(spark):
    text = plan(roc.roc_table(table(spark, [(1, 0.5, "a")], SCORED + ", g string"), by=["g"]))
    assert "SinglePartition" not in text and "Python" not in text


def test_confusion_always_two_by_two(spark):
    df = table(spark, [(0, 0), (0, 0)], "label int, prediction int")
    assert confusion_matrix(df) == [[2, 0], [0, 0]]
    r = binary_metrics(df, extended=True).first()
    assert (r["precision"], r["recall"], r["f1"], r["auc"], r["mcc"]) == (0, 0, 0, 0.5, 0)


def test_metrics_values(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4 + [(None, 1), (1, None)]
    r = binary_metrics(table(spark, rows, "label int, prediction int"), extended=True).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (3, 1, 2, 4)
    assert r["accuracy"] == 0.7 and r["precision"] == 0.6 and r["recall"] == 0.75
    assert r["f1"] == pytest.approx(2 * 0.6 * 0.75 / 1.35) and r["auc"] == pytest.approx((0.75 + 4 / 6) / 2)


def test_probability_cut(spark):
    df = table(spark, MIXED, SCORED)
    assert precision_recall(df, "score", threshold=0.65).first().asDict() == {"precision": 1.0, "recall": 0.75}
    with pytest.raises(ValueError):
        cut_probability(df, "score", 1.5)


def test_flags_in_one_pass(spark):
    df = table(spark, [(1, 1, 0), (0, 1, 0), (0, 0, 1)], "label int, a int, b int")
    got = {r["flag"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in flag_metrics(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 1, 0, 1), "b": (0, 1, 1, 1)}


def test_class_rates(spark):
    df = table(spark, [(0,)] * 299 + [(1,)], "label int")
    r = class_rates(df).first()
    assert (r["n"], r["positives"], r["low_rate"]) == (300, 1, 1)


ROWS = [("a", "x", 0.7, 0.5), ("a", "y", 0.6, 0.5), ("b", "x", 0.8, 0.1), ("b", "y", 0.9, 0.2)]


def test_comparisons(spark):
    m = table(spark, ROWS, "cohort string, method string, auc double, f1 double")
    assert [r["method"] for r in compare_methods(m).collect()] == ["y", "x", "x", "y"]
    assert "Auc" in compare_methods([m], titled=True).columns
    with pytest.raises(ValueError, match="empty"):
        compare_methods([])
    w = {(r["cohort"], r["metric"]): r["winner"] for r in winners(m, "x", "y", ["cohort"]).collect()}
    assert w == {("a", "auc"): "x", ("a", "f1"): "tie", ("b", "auc"): "y", ("b", "f1"): "y"}
    s = {r["cohort"]: r for r in cohort_summary(m.where("NOT (cohort = 'b' AND method = 'y')"), ["x", "y"], ["auc"]).collect()}
    assert s["b"]["y_auc"] == 0.0 and s["a"]["x_auc"] == 0.7
    avg = {r["method"]: (r["auc"], r["winner"]) for r in method_averages(m, ["auc"]).collect()}
    assert avg["x"] == (pytest.approx(0.75), True) and avg["y"][1] == (avg["y"][0] == avg["x"][0])


def test_rule_table(spark):
    m = table(spark, [("m1", 0.7)], "method string, auc double")
    rule = Rule("wbc", 11.0, "high", "m1", 4, {"weights": {"wbc": 0.25}})
    r = rule_table(m, rule.as_table(m)).first()
    assert (r["formula"], r["importance"], r["threshold"]) == ("wbc >= 11.0000", "0.2500", 11.0)
