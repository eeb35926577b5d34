"""Rule finders, models, attribution and feature ranking."""

import itertools
import math

import numpy as np
import pytest

from cohortspark.operators.attribution import (
    attribute,
    direction_of,
    explain_batch,
    importance,
    leaf_table,
    node_table,
    linear_attribution,
    mean_with_error,
    model_info,
    summarise,
    top_features,
    tree_base,
)
from cohortspark.operators.models import Baseline, fit_logistic, fit_model, model_kind
from cohortspark.operators.selection import (
    FeatureSelector,
    f_scores,
    importance_agreement,
    mutual_information,
    rank_agreement,
)
from cohortspark.operators.thresholds import (
    AttributionLiteratureRule,
    AttributionYoudenRule,
    LiteratureRule,
    QuantileFlags,
    RangeFlags,
    Rule,
    YoudenRule,
    resolve_threshold,
)
from cohortspark.plans.experiment import (
    cross_validate,
    evaluate_flags,
    evaluate_model,
    evaluate_rule,
    evaluate_rules,
    run_cohorts,
    run_experiment,
    summarise_cohorts,
)

from cohortspark.session import stage

from helpers import column, lcg, plan, table

FEATURES = ["hemoglobin", "wbc", "platelets"]
SCHEMA = "subject_id bigint, hemoglobin double, wbc double, platelets double, label int"
LIMITS = {"hemoglobin": {"low": 12.0, "high": 17.5}, "wbc": {"low": 4.5, "high": 11.0}, "platelets": {"low": 150, "high": 400}}


def rows_low(n=200):
    """Low hemoglobin marks class 1; every tenth label is flipped."""
    a, b, c = lcg(n, 11), lcg(n, 12), lcg(n, 13)
    out = []
    for i in range(n):
        hb = 8 + 9 * a[i]
        y = int(hb < 12)
        out.append((i, hb, 4 + 8 * b[i], 150 + 250 * c[i], 1 - y if i % 10 == 0 else y))
    return out


@pytest.fixture(scope="module")
def low(spark):
    return table(spark, rows_low(), SCHEMA).cache()


def test_resolve_threshold():
    assert resolve_threshold(LIMITS, "wbc", "high") == 11.0
    assert resolve_threshold(LIMITS, "wbc", "low") == 4.5
    assert resolve_threshold(LIMITS, "wbc_max", "high") == 11.0
    assert resolve_threshold({"wbc": 9}, "wbc", "low") == 9.0
    assert resolve_threshold({"wbc": {"threshold": 3}}, "wbc", "low") == 3.0
    assert resolve_threshold({"wbc": {"low": 3}}, "wbc", "high") == 3.0
    assert resolve_threshold(LIMITS, "mcv", "low") is None


def test_literature_rule(low):
    finder = LiteratureRule(LIMITS)
    with pytest.raises(RuntimeError):
        finder.transform(low)
    rule = finder.fit(low, FEATURES)
    assert (rule.feature, rule.direction, rule.threshold) == ("hemoglobin", "low", 12.0)
    assert rule.formula == "hemoglobin <= 12.0" and "hemoglobin" in finder.describe()
    got = finder.transform(low).collect()
    assert all(r["prediction"] == int(r["hemoglobin"] <= 12.0) for r in got)
    assert evaluate_rule(rule, low).first()["accuracy"] >= 0.85


def test_literature_rule_without_limit(low):
    with pytest.raises(ValueError, match="hemoglobin"):
        LiteratureRule({"wbc": 9}, only_with_limit=False).fit(low, FEATURES)
    assert LiteratureRule({"wbc": 9}).fit(low, FEATURES).feature == "wbc"
    with pytest.raises(ValueError, match="no feature"):
        LiteratureRule({"mcv": 9}).fit(low, FEATURES)


def test_training_checks(low):
    with pytest.raises(ValueError, match="two classes"):
        LiteratureRule(LIMITS).fit(low.where("label = 1"), FEATURES)
    with pytest.raises(ValueError, match="absent"):
        YoudenRule().fit(low, ["absent"])
    with pytest.raises(ValueError):
        YoudenRule().fit(low, [])


def test_youden_rule(low):
    single = YoudenRule().fit(low, FEATURES)
    assert single.feature == "hemoglobin" and single.direction == "low"
    assert 11 < single.threshold < 13 and single.metadata["optimization"] == "single"
    cv = YoudenRule(["subject_id"], 5).fit(low, FEATURES)
    assert len(cv.metadata["cv_thresholds"]) == 5
    assert cv.threshold == pytest.approx(sum(cv.metadata["cv_thresholds"]) / 5)
    assert -1 <= cv.metadata["youden_index"] <= 1 and cv.formula.startswith("hemoglobin <= 1")
    again = YoudenRule(["subject_id"], 5).fit(low, FEATURES)
    assert again.threshold == cv.threshold
    # taking high values as positive is far from the break at 12
    assert YoudenRule(direction_aware=False).fit(low, FEATURES).metadata["youden_index"] < 0.3


def test_logistic_matches_closed_loss(low):
    """The penalised optimum beats its neighbours on the summed loss."""
    model = fit_logistic(low, ["wbc", "hemoglobin"], c=1.0)
    rows = [(r["wbc"], r["hemoglobin"], r["label"]) for r in low.collect()]

    def loss(w0, w1, b0):
        total = 0.5 * (w0 * w0 + w1 * w1)
        for x0, x1, y in rows:
            z = w0 * x0 + w1 * x1 + b0
            total += math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))
        return total

    w = [*model.weights.values(), model.intercept]
    best = loss(*w)
    for i in range(3):
        for d in (-0.02, 0.02):
            moved = list(w)
            moved[i] += d
            assert loss(*moved) >= best - 1e-6


def test_null_feature_gives_null_prediction(spark):
    df = table(spark, [(1.0,), (None,)], "wbc double")
    assert column(Rule("wbc", 1.0, "high").transform(df), "prediction") == [1, None]


def test_range_and_quantile_flags(spark):
    df = table(spark, [(1, 3.0, 0), (2, 7.0, 0), (3, 12.0, 1), (4, None, 1)], "id int, wbc double, label int")
    flags = RangeFlags(LIMITS).fit(df, ["wbc"])
    got = {r["id"]: (r["wbc_low"], r["wbc_high"], r["wbc_abnormal"]) for r in flags.transform(df).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 0, 0), 3: (0, 1, 1), 4: (None, None, None)}
    q = QuantileFlags(0, 50).fit(df, ["wbc"])
    assert q.thresholds["wbc"] == {"low": 3.0, "high": 7.0}
    assert QuantileFlags(method="optimal").fit(df, ["wbc"]).thresholds["wbc"]["high"] == 12.0
    with pytest.raises(ValueError):
        QuantileFlags(method="best")


def test_flag_evaluation(low):
    row = evaluate_flags(RangeFlags(LIMITS), low, low, FEATURES).first()
    assert 0 <= row["auc"] <= 1 and row["tp"] + row["fp"] + row["tn"] + row["fn"] == 200
    with pytest.raises(ValueError):
        evaluate_flags(RangeFlags({}), low, low, FEATURES)


# --- attribution -------------------------------------------------------------


def test_linear_attribution_adds_up(low):
    weights = {"hemoglobin": -1.0, "wbc": 0.5, "platelets": 0.0}
    phi = linear_attribution(low, FEATURES, weights, ["subject_id"])
    means = low.selectExpr(*[f"avg({f}) AS {f}" for f in FEATURES]).first()
    total = {r["subject_id"]: r["s"] for r in phi.groupBy("subject_id").sum("phi").withColumnRenamed("sum(phi)", "s").collect()}
    for r in low.collect():
        want = sum(weights[f] * (r[f] - means[f]) for f in FEATURES)
        assert total[r["subject_id"]] == pytest.approx(want, abs=1e-9)


def brute_shapley(leaves, x):
    """Shapley values of the path-dependent game by enumerating coalitions."""
    n = len(x)

    def value(known):
        total = 0.0
        for features, low, high, share, out in leaves:
            for i in range(len(out)):
                w = out[i]
                for f, lo, hi, z in zip(features[i], low[i], high[i], share[i]):
                    w *= float(lo < x[f] <= hi) if f in known else z
                total += w
        return total

    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for known in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                phi[i] += weight * (value({*known, i}) - value(set(known)))
    return phi


@pytest.mark.parametrize("kind", ["random_forest", "boosted_trees"])
def test_tree_attribution_is_exact_and_adds_up(spark, low, kind):
    model = fit_model(low, FEATURES, kind=kind, settings={"trees": 4, "depth": 5})
    leaves = leaf_table(model, node_table(model, spark))
    sample = low.orderBy("subject_id").limit(12).collect()
    x = np.array([[r[f] for f in FEATURES] for r in sample])
    phi = explain_batch(x, leaves)
    for i in range(4):
        assert phi[i] == pytest.approx(brute_shapley(leaves, x[i]), abs=1e-9)
    ids = [r["subject_id"] for r in sample]
    scored = {r["subject_id"]: r["probability"] for r in model.predict(low).collect()}
    for i, s in enumerate(ids):
        p = scored[s]
        want = p if kind == "random_forest" else 0.5 * math.log(p / (1 - p))
        assert phi[i].sum() + tree_base(leaves) == pytest.approx(want, abs=1e-6)
    spread = attribute(model, low, ["subject_id"])
    assert spread.count() == 600
    mine = {r["feature"]: r["phi"] for r in spread.where(f"subject_id = {ids[0]}").collect()}
    assert [mine[f] for f in FEATURES] == pytest.approx(list(phi[0]))
    assert model_info(model, low)["base_value"] == pytest.approx(tree_base(leaves))


def test_batch_function_needs_no_package_on_the_executor(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(explain_batch))
    code = "import pickle, numpy; f = pickle.load(open('f.pkl', 'rb')); print(f(numpy.ones((2, 3)), []).shape)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "(2, 3)", done.stderr


def test_tree_ranking_and_direction(low):
    model = fit_model(low, FEATURES, settings={"trees": 10, "depth": 4})
    summary = summarise(attribute(model, low, ["subject_id"]), FEATURES)
    assert top_features(summary, 1) == ["hemoglobin"]
    assert len(top_features(summary, 9)) == 3
    assert direction_of(summary, "hemoglobin") == "low"
    assert direction_of(summary, "hemoglobin", "mean_phi") in ("low", "high")
    with pytest.raises(ValueError):
        top_features(summary, 0)


def test_sampled_attribution_adds_up(low):
    model = fit_model(low, FEATURES, kind="logistic_regression")
    background = low.orderBy("subject_id").limit(1)
    phi = attribute(model, low, ["subject_id"], "sampled", background=background, permutations=3)
    scored = {r["subject_id"]: r["probability"] for r in model.predict(low).collect()}
    base = scored[0]
    total = {r["subject_id"]: r["s"] for r in phi.groupBy("subject_id").sum("phi").withColumnRenamed("sum(phi)", "s").collect()}
    assert len(total) == 200
    for s, t in total.items():
        assert t == pytest.approx(scored[s] - base, abs=1e-9)
    values = {r["subject_id"]: r["value"] for r in phi.where("feature = 'wbc'").collect()}
    assert values == {r["subject_id"]: r["wbc"] for r in low.collect()}


def test_sampled_attribution_error(low):
    model = fit_model(low, FEATURES, kind="logistic_regression")
    phi = stage(attribute(model, low, ["subject_id"], "sampled", permutations=16, output="log_odds"))
    exact = {(r["subject_id"], r["feature"]): r["phi"] for r in attribute(model, low, ["subject_id"]).collect()}
    rows = phi.collect()
    assert len(rows) == 200 * len(FEATURES) and all(r["se"] >= 0 for r in rows)
    inside = [abs(r["phi"] - exact[r["subject_id"], r["feature"]]) <= 3 * r["se"] + 1e-9 for r in rows]
    assert sum(inside) / len(inside) > 0.95
    for r in mean_with_error(phi).collect():
        mean = sum(v for (_, f), v in exact.items() if f == r["feature"]) / 200
        assert r["n"] == 200 and abs(r["mean_phi"] - mean) <= 3 * r["se"] + 1e-9
    assert attribute(model, low, ["subject_id"], "sampled", permutations=1).where("se IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="output"):
        attribute(model, low, ["subject_id"], "sampled", output="margin")


def test_sampled_walks_are_summed_before_they_move(low):
    model = fit_model(low, FEATURES, kind="logistic_regression")
    text = plan(attribute(model, low, ["subject_id"], "sampled"))
    arguments = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning(subject_id")]
    assert len(arguments) == 1  # neither grouping shuffles again


def test_attribution_rules(low):
    options = {"settings": {"trees": 10, "depth": 4}}
    lit = AttributionLiteratureRule(LIMITS, **options).fit(low, FEATURES)
    assert (lit.feature, lit.threshold, lit.direction) == ("hemoglobin", 12.0, "low")
    you = AttributionYoudenRule(**options).fit(low, FEATURES)
    assert you.feature == "hemoglobin" and 11 < you.threshold < 13
    linear = AttributionYoudenRule(model="logistic_regression", use_cv=False).fit(low, FEATURES)
    assert linear.metadata["optimization"] == "single"
    with pytest.raises(ValueError, match="unknown model"):
        AttributionYoudenRule(model="svm").fit(low, FEATURES)


def test_models(low):
    assert model_kind("XGBoost") == "boosted_trees" and model_kind("RandomForest") == "random_forest"
    model = Baseline("random_forest", trees=5, depth=3)
    with pytest.raises(RuntimeError):
        model.predict(low)
    model.fit(low, FEATURES)
    p = column(model.predict_proba(low), "probability")
    assert all(0 <= v <= 1 for v in p) and model.params()["trees"] == 5
    assert set(column(model.predict(low), "prediction")) == {0, 1}


def test_missing_feature_fails_the_fit(spark):
    df = table(spark, [(1.0, 0), (None, 1)], "wbc double, label int")
    with pytest.raises(Exception, match="impute first"):
        fit_logistic(df, ["wbc"])


# --- ranking -----------------------------------------------------------------


@pytest.mark.parametrize("method", ["mutual_info", "f_classif", "lasso", "rfe"])
def test_selectors_find_the_signal(low, method):
    scaled = low.selectExpr("subject_id", "label", "(hemoglobin - 12) / 3 AS hemoglobin", "(wbc - 8) / 2 AS wbc", "(platelets - 275) / 70 AS platelets")
    selector = FeatureSelector(method, k=1).fit(scaled, FEATURES)
    assert selector.selected() == ["hemoglobin"]
    assert "wbc" not in selector.transform(scaled).columns


def test_selector_checks(low):
    with pytest.raises(ValueError):
        FeatureSelector("chi2")
    with pytest.raises(RuntimeError):
        FeatureSelector().ranking()
    assert f_scores(low, ["wbc"]).first()["score"] >= 0
    assert mutual_information(low, ["wbc"], bins=2).first()["score"] >= 0


def brute_kendall(rows):
    s = nx = ny = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += ((a > c) - (a < c)) * ((b > d) - (b < d))
        nx += a != c
        ny += b != d
    return s / math.sqrt(nx * ny)


def test_rank_agreement(spark):
    rows = [(round(a * 9), round((a + b) * 6)) for a, b in zip(lcg(120, 3), lcg(120, 9))] + [(4, 4)] * 60
    df = table(spark, [(float(a), float(b)) for a, b in rows], "a double, b double")
    r = rank_agreement(df, "a", "b").first()
    assert r["kendall"] == pytest.approx(brute_kendall(rows), abs=1e-12)
    ranks = []
    for k in (0, 1):
        v = [x[k] for x in rows]
        ranks.append([sum(o < x for o in v) + (sum(o == x for o in v) + 1) / 2 for x in v])
    assert r["spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12)
    same = importance_agreement(spark, {"a": 1, "b": 2, "c": 3}, {"a": 10, "b": 20, "c": 30})
    assert same["kendall"] == pytest.approx(1) and same["spearman"] == pytest.approx(1)
    flat = rank_agreement(table(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()
    assert flat["kendall"] is None and flat["spearman"] is None


# --- experiments -------------------------------------------------------------


def test_experiment(spark, low, tmp_path):
    done, failed = run_cohorts(
        {"good": low, "bad": low.where("label = 1")}, FEATURES, lambda _: LIMITS, n_folds=3
    )
    assert list(done) == ["good"] and "bad" in failed
    e = done["good"]
    assert {r["method"] for r in e.metrics.collect()} == {"logistic_literature", "logistic_youden"}
    assert e.predictions.count() == 61 and e.winners().count() == 7
    paths = e.save(str(tmp_path / "out"))
    assert spark.read.json(paths["metrics"]).count() == 2
    assert spark.read.parquet(paths["predictions"]).count() == 61
    summary, averages = summarise_cohorts(done)
    assert summary.count() == 1 and averages.count() == 2
    with pytest.raises(ValueError):
        summarise_cohorts({})


def test_model_evaluation(low):
    model = fit_model(low, FEATURES, kind="logistic_regression")
    row = evaluate_model(model, low).first()
    scored = [(r["label"], r["probability"]) for r in model.predict(low).collect()]
    pos = [p for y, p in scored if y == 1]
    neg = [p for y, p in scored if y == 0]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert row["auc"] == pytest.approx(want) and 0 < row["pr_auc"] <= 1
    assert row["tp"] == sum(p >= 0.5 for p in pos)


def test_rules_are_scored_in_one_pass(low):
    rules = [Rule("wbc", 8.0, "high", "a"), Rule("wbc", 8.0, "low", "b")]
    got = {r["method"]: r for r in evaluate_rules(rules, low).collect()}
    alone = evaluate_rule(rules[0], low).first()
    assert got["a"].asDict() == alone.asDict() and set(got) == {"a", "b"}
    with pytest.raises(ValueError):
        evaluate_rules([], low)


def test_cross_validation(low):
    rows = cross_validate(YoudenRule, low, FEATURES, ["subject_id"], 3).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2]
    assert sum(r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in rows) == 200


def test_importance_is_one_row_per_feature(low):
    phi = linear_attribution(low, FEATURES, dict.fromkeys(FEATURES, 1.0), ["subject_id"])
    assert importance(phi).count() == 3
    experiment = run_experiment(low, FEATURES, "c", LIMITS, n_folds=3, rank_scaled=False)
    assert experiment.info["positives"] > 0


def test_rank_agreement_takes_a_fixed_number_of_jobs(spark):
    def jobs(n):
        df = table(spark, list(zip(lcg(n, 3), lcg(n, 4))), "a double, b double")
        spark.sparkContext.setJobGroup(f"agreement-{n}", "")
        rank_agreement(df, "a", "b")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"agreement-{n}"))

    small, large = jobs(20), jobs(2_000)
    assert large <= small + 2
