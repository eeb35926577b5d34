"""Cases that once lost rows or values without a word."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.codes import starts_with_any
from cohortspark.operators import attribution
from cohortspark.operators.attribution import attribute, model_info
from cohortspark.operators.cohort import full_coalesce_join, match_codes
from cohortspark.operators.models import fit_model
from cohortspark.operators.panel import Obs, lookback
from cohortspark.operators.prepare import Scaler
from cohortspark.operators.profile import demographics
from cohortspark.operators.thresholds import Rule, apply_rules
from cohortspark.plans.dataset import cohort_frames
from cohortspark.plans.experiment import configured_finders, evaluate_rules, run_cohorts
from cohortspark.sources.config import CodeRule, Config, expand_code, load_config, parse_models
from cohortspark.sources.sinks import code_filter


def test_code_filter_keeps_dotted_codes_and_survives_no_rules(spark):
    codes = spark.createDataFrame([("714.0",), ("7140",), ("71",), ("99%",), (None,)], "icd_code string")
    config = Config(cohorts={"a": {"codes": {"9": ["714.0"]}}, "b": {"codes": {"9": ["9%"]}}})
    assert {r[0] for r in codes.where(code_filter(config)).collect()} == {"714.0", "7140"}
    assert {r[0] for r in codes.where(code_filter(config, dots=True)).collect()} == {"714.0"}
    assert codes.where(code_filter(Config())).count() == 0


def test_first_characters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "codes")
    spark.createDataFrame([("714.0", "9"), (".7140", "9"), ("E10", "10")], "icd_code string, icd_version string").write.parquet(path)
    facts = spark.read.parquet(path)
    found = match_codes(facts, [CodeRule("a", "9", "714.0"), CodeRule("b", "10", "E1")])
    assert {(r["icd_code"], r["cohort"]) for r in found.collect()} == {("714.0", "a"), (".7140", "a"), ("E10", "b")}
    assert "StringStartsWith(icd_code,7)" in found._jdf.queryExecution().toString()
    assert facts.where(starts_with_any("icd_code", [])).count() == 0


def test_lookback_without_its_time_column_raises(spark):
    obs = spark.createDataFrame([(1, 2.0)], "subject_id long, valuenum double")
    with pytest.raises(ValueError, match="charttime"):
        lookback(obs, 30, Obs())
    assert lookback(obs, None, Obs()).count() == 1


def test_full_join_refuses_repeated_keys_and_shared_columns(spark):
    a = spark.createDataFrame([(1, 10), (1, 20)], "k long, a long")
    b = spark.createDataFrame([(1, 5), (2, None)], "k long, b long")
    with pytest.raises(Exception, match="more than once"):
        full_coalesce_join([a, b], ["k"]).collect()
    with pytest.raises(ValueError, match="several frames"):
        full_coalesce_join([b, b], ["k"])
    one = a.where("a = 10")
    assert {tuple(r) for r in full_coalesce_join([one, b], ["k"]).collect()} == {(1, 10, 5), (2, None, None)}


def test_small_numbers_are_scaled(spark):
    df = spark.createDataFrame([(1, 1e-13, 7.0), (2, 3e-13, 7.0), (3, 5e-13, 7.0)], "subject_id long, x double, c double")
    out = Scaler("standard", ["subject_id"]).fit_transform(df).orderBy("subject_id").collect()
    assert [r["x"] for r in out] == pytest.approx([-1.2247448714, 0, 1.2247448714])
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("code", "expected"),
    [("714-716", ["714", "715", "716"]), ("714.8-715.1", ["714.8", "714.9", "715.0", "715.1"]), ("M05-M07", ["M05", "M06", "M07"]), ("008-010", ["008", "009", "010"])],
)
def test_code_ranges_over_stems(code, expected):
    assert expand_code(code) == expected


@pytest.mark.parametrize("code", ["714-M15", "714.0-715", "716-714", "a-b", "1-2-3"])
def test_unknown_ranges_raise(code):
    with pytest.raises(ValueError):
        expand_code(code)


def test_cohorts_without_members_keep_their_row(spark):
    members = spark.createDataFrame([("a", 1, 10)], "cohort string, subject_id long, hadm_id long")
    people = spark.createDataFrame([(1, 50, "F")], "subject_id long, anchor_age int, gender string")
    stays = spark.createDataFrame([(10, 1)], "hadm_id long, hospital_expire_flag int")
    rows = {r["cohort"]: r for r in demographics(members, people, stays, cohorts=["a", "b"]).collect()}
    assert rows["b"]["subjects"] == rows["b"]["encounters"] == rows["b"]["deaths"] == 0 and rows["b"]["mean_age"] is None
    assert rows["a"]["deaths"] == 1


def test_tree_attribution_refuses_missing_features(spark):
    pick = np.random.default_rng(0)
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(pick.normal(0, 1, (80, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, label int")
    model = fit_model(df, ["a", "b"], kind="random_forest", settings={"trees": 3, "depth": 3})
    assert attribute(model, df, ["k"]).count() == 160
    with pytest.raises(Exception, match="every feature"):
        attribute(model, df.withColumn("a", F.when(F.col("k") > 3, F.col("a"))), ["k"]).collect()


def test_rules_with_one_name_are_refused(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 1)], "x double, label int")
    rules = [Rule("x", 2.0, "high", "r"), Rule("x", 0.0, "high", "r")]
    with pytest.raises(ValueError, match="different names"):
        evaluate_rules(rules, df)
    with pytest.raises(ValueError, match="different names"):
        apply_rules(df, rules)
    named = evaluate_rules(rules, df, methods=["first", "second"]).collect()
    assert {r["method"] for r in named} == {"first", "second"}


def test_any_failure_of_a_cohort_leaves_the_others(spark):
    pick = np.random.default_rng(1)
    rows = [(i, float(v), int(v + n > 0)) for i, (v, n) in enumerate(pick.normal(0, 1, (120, 2)))]
    good = spark.createDataFrame(rows, "subject_id long, x double, label int")
    broken = good.withColumn("x", F.expr("if(subject_id = 5, raise_error('bad row'), x)"))
    done, failed = run_cohorts({"good": good, "broken": broken}, ["x"], lambda _: {"x": {"high": 0.0}})
    assert list(done) == ["good"] and "bad row" in failed["broken"]


def test_trees_in_several_passes_give_the_same_values(spark, monkeypatch):
    pick = np.random.default_rng(3)
    rows = [(i, float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(pick.normal(0, 1, (60, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, label int")
    model = fit_model(df, ["a", "b"], kind="random_forest", settings={"trees": 4, "depth": 3})
    whole = {(r["k"], r["feature"]): r["phi"] for r in attribute(model, df, ["k"]).collect()}
    base = model_info(model, df)["base_value"]
    monkeypatch.setattr(attribution, "PASS_NODES", 5)
    parts = {(r["k"], r["feature"]): r["phi"] for r in attribute(model, df, ["k"]).collect()}
    assert parts == pytest.approx(whole) and model_info(model, df)["base_value"] == pytest.approx(base)


def test_the_whole_background_is_drawn_from(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(500)], "k long, x double").repartition(7)
    pool, size = attribution.background_pool(df, ["x"], ["k"])
    rows = pool.collect()
    assert size == 500 and sorted(r["__b"] for r in rows) == list(range(500))
    assert sorted(r["__ref"][0] for r in rows) == [float(i) for i in range(500)]
    assert attribution.background_pool(df, ["x"], ["k"], 20)[1] == 20


def test_one_pass_datasets_match_single_ones(spark):
    features = spark.createDataFrame([(i, float(i) if i % 4 else None) for i in range(40)], "subject_id long, x double")
    labels = spark.createDataFrame([(i, c, int(i % n == 0)) for i in range(38) for c, n in (("a", 2), ("b", 3))], "subject_id long, cohort string, label int")
    data = cohort_frames(features, labels)
    assert data.frame.groupBy("subject_id").agg(F.countDistinct("x").alias("n")).where("n <> 1").count() == 0
    assert data.frame.count() == 76 and {r[0] for r in data.frame.select("split").distinct().collect()} == {"train", "val", "test"}
    everything = cohort_frames(features, labels, fit_on="all", scale=None).frame
    middle = np.median([float(i) for i in range(38) if i % 4])
    assert everything.where("subject_id = 4").first()["x"] == middle


YAML = """
cohorts: {}
default_disease: ra
diseases:
  ra: {name: RA, icd9_codes: ["714.0"], relevant_biomarkers: [wbc]}
  t1: {name: T1, icd9_codes: ["250.01"]}
cbc_features:
  wbc: {itemids: [1], reference_range: {low: 4, high: 11}}
  rdw: {itemids: [2]}
shap_config:
  default_model: {model_type: RandomForest, n_estimators: 7, max_depth: 3, random_state: 5}
  models:
    xgboost: {model_type: XGBoost, n_estimators: 9, learning_rate: 0.2}
  cross_validation: {use_cv: false, cv_folds: 4}
"""


def test_model_settings_of_a_file_reach_the_finders(spark, tmp_path):
    (tmp_path / "all.yaml").write_text(YAML)
    config = load_config(str(tmp_path))
    assert config.default_cohort == "ra" and config.relevant_features("ra") == ["wbc"] and config.relevant_features("t1") == ["wbc", "rdw"]
    assert config.model() == ("random_forest", {"trees": 7, "depth": 3, "seed": 5})
    assert config.model("boosted_trees") == ("boosted_trees", {"trees": 9, "rate": 0.2})
    finders = configured_finders(config, "ra", ["k"])
    cut = finders["attribution_youden"]
    assert not cut.use_cv and cut.n_folds == 4 and cut.settings == {"trees": 7, "depth": 3} and cut.seed == 5
    df = spark.createDataFrame([(i, float(i), i % 7 * 1.0, int(i > 20)) for i in range(40)], "k long, wbc double, rdw double, label int")
    rule = cut.fit(df, ["wbc", "rdw"])
    assert rule.feature == "wbc" and cut.model.model.getNumTrees == 7
    for bad in ({"models": {"svm": {}}}, {"default_model": {"model_type": "RandomForest", "n_trees": 3}}, {"extra": {}}, {"cross_validation": {"k": 3}}):
        with pytest.raises(ValueError):
            parse_models(bad)
