"""Reports on hand-made tables."""

import math

import numpy as np
import pytest

from cohortspark.functions.numbers import t_two_sided
from cohortspark.operators import profile
from cohortspark.sources import CodeRule

from helpers import column, plan, table

RULES = [CodeRule("a", "9", "1"), CodeRule("b", "9", "2"), CodeRule("none", "9", "7")]
FACTS = [(1, 10, "11", 9), (1, 11, "12", 9), (2, 20, "1", 9), (2, 20, "2", 9), (3, 30, "3", 9)]


@pytest.fixture
def facts(spark):
    return table(spark, FACTS, "subject_id bigint, hadm_id bigint, icd_code string, icd_version int")


def test_counts_and_balance(facts):
    counts = profile.cohort_counts(facts, RULES)
    got = {r["cohort"]: (r["subjects"], r["encounters"], r["facts"]) for r in counts.collect()}
    assert got == {"a": (2, 3, 3), "b": (1, 1, 1), "none": (0, 0, 0)}
    balance = {r["cohort"]: r for r in profile.class_balance(counts, 4, 5).collect()}
    assert balance["a"]["subject_ratio"] == "1:1.0" and balance["none"]["subject_ratio"] == "N/A"
    assert balance["b"]["subject_prevalence"] == 25.0 and balance["b"]["encounter_neg"] == 4
    advice = {r["cohort"]: r["strategy"] for r in profile.imbalance_strategy(profile.class_balance(counts, 4, 5)).collect()}
    assert advice["none"].startswith("SMOTE") and advice["b"].startswith("Standard")


def test_demographics(spark, facts):
    people = table(spark, [(1, 40.0, "F"), (2, 60.0, "M")], "subject_id bigint, anchor_age double, gender string")
    stays = table(spark, [(10, 0), (11, 1), (20, 0)], "hadm_id bigint, hospital_expire_flag int")
    members = profile.cohort_encounters(facts, RULES)
    got = {r["cohort"]: r for r in profile.demographics(members, people, stays).collect()}
    assert got["a"]["mean_age"] == 50 and got["a"]["median_age"] == 50 and got["a"]["pct_f"] == 50
    assert got["a"]["deaths"] == 1 and got["a"]["mortality_pct"] == pytest.approx(100 / 3)
    found = {r["measure"]: r for r in profile.extremes(profile.demographics(members, people), "cohort", ["mean_age"]).collect()}
    assert found["mean_age"]["max_key"] == "b"


def test_availability_and_missingness(spark, facts):
    obs = table(spark, [(1, 10, "hb"), (1, 10, "hb"), (1, 99, "hb"), (2, 20, "wbc")], "subject_id bigint, hadm_id bigint, feature string")
    counts = profile.test_counts(obs, profile.cohort_encounters(facts, RULES))
    available = profile.availability(counts, profile.cohort_counts(facts, RULES))
    got = {r["cohort"]: r for r in available.collect()}
    assert (got["a"]["with_tests"], got["a"]["tests"], got["a"]["median_tests"]) == (2, 3, 1.5)
    assert (got["none"]["tests"], got["none"]["median_tests"]) == (0, 0.0)
    missing = profile.missingness(counts, ["a", "b", "none"], ["hb", "wbc"])
    rows = {(r["cohort"], r["feature"]): r for r in missing.collect()}
    assert len(rows) == 6 and rows[("a", "hb")]["pct_with"] == 50 and rows[("none", "hb")]["pct_missing"] == 100
    wide = profile.missingness_pivot(missing, ["wbc", "hb"])
    assert wide.columns == ["cohort", "wbc", "hb"]
    assert profile.feature_completeness(missing).count() == 2
    assert set(column(profile.coverage_assessment(available), "sufficiency")) == {"insufficient"}


def test_histogram_edges(spark):
    df = table(spark, [("a", v) for v in (0.0, 1.0, 9.99, 10.0)] + [("b", 5.0), ("c", None)], "g string, v double")
    got = {(r["g"], r["bin"]): r["n"] for r in profile.histogram(df, "v", 10, ["g"]).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 10): 2, ("b", 1): 1}
    assert profile.histogram(df.where("g = 'a'"), "v", 2).count() == 2


def test_describe_and_outliers(spark):
    df = table(spark, [("a", float(i)) for i in range(100)] + [("a", 10_000.0), ("b", 1.0)], "feature string, valuenum double")
    d = {r["feature"]: r for r in profile.describe(df, "valuenum", ["feature"]).collect()}
    assert (d["a"]["n"], d["a"]["median"], d["b"]["std"]) == (101, 50.0, None)
    assert profile.describe(df, "valuenum").first()["n"] == 102
    o = {r["feature"]: r for r in profile.outliers(df, "valuenum").collect()}
    assert o["a"]["sigma_outliers"] == 1 and o["a"]["iqr_outliers"] == 1 and o["b"]["sigma_outliers"] == 0
    assert column(profile.top(profile.outliers(df, "valuenum"), "sigma_pct", 1, "feature"), "feature") == ["a"]
    limits = table(spark, [("a", 10.0, 90.0)], "feature string, low double, high double")
    r = {x["feature"]: x for x in profile.range_check(df, limits, "valuenum").collect()}
    assert r["a"]["pct_below"] == pytest.approx(1000 / 101) and r["b"]["ref_low"] is None


def test_null_audit_and_codes(spark, facts):
    df = table(spark, [(1, None), (2, float("nan")), (3, 4.0)], "k int, v double")
    got = {r["column"]: (r["nulls"], r["pct"]) for r in profile.null_audit(df).collect()}
    assert got == {"k": (0, 0.0), "v": (2, pytest.approx(200 / 3))}
    codes = {(r["kind"], r["item"]): r["n"] for r in profile.code_audit(facts, ["1.1"]).collect()}
    assert codes[("system", "9")] == 5 and codes[("prefix", "11")] == 1
    assert codes[("without_dots", "1.1")] == 1 and ("as_written", "1.1") not in codes


def test_group_difference(spark):
    df = table(spark, [(1, 1.0), (1, 2.0), (1, 3.0), (0, 5.0), (0, 9.0)], "label int, x double")
    r = profile.group_difference(df, ["x"]).first()
    assert r["t"] == pytest.approx((2 - 7) / (1 / 3 + 8 / 2) ** 0.5)
    assert profile.report_where(df, {"x": (2, 9)}).count() == 3
    alone = profile.group_difference(df.where("label = 1"), ["x"]).first()
    assert alone["t"] is None and alone["n0"] == 0 and alone["p"] is None


def test_p_value_against_numerical_integration(spark):
    cases = [(t, dof) for t in (1e-6, 0.3, -1.7, 1.74, 4.0, 30.0) for dof in (0.7, 1.0, 3.5, 40.0, 12345.6, 3e7)]
    found = table(spark, cases, "t double, dof double").selectExpr("t", "dof", f"{t_two_sided('t', 'dof')} AS p").collect()
    for r in found:
        # with t = sqrt(dof) tan(w) the density is cos(w)^(dof - 1); w^2 near pi/2 is substituted away below dof 1
        half, dof = math.atan(abs(r["t"]) / math.sqrt(r["dof"])), r["dof"]
        nodes, weights = np.polynomial.legendre.leggauss(200)
        wide = min(half, 14 / math.sqrt(dof))
        inside = wide / 2 * float(weights @ np.cos(wide / 2 * (nodes + 1)) ** (dof - 1))
        z = dof / 2
        if z > 500:
            ratio = math.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z))
        else:
            ratio = math.exp(math.lgamma(z + 0.5) - math.lgamma(z))
        assert abs(r["p"] - (1 - 2 * inside * ratio / math.sqrt(math.pi))) < 1e-9
    edge = table(spark, [(0.0, 3.0), (None, 3.0), (1.0, None)], "t double, dof double")
    assert [r[0] for r in edge.selectExpr(t_two_sided("t", "dof")).collect()] == [1.0, None, None]


@pytest.mark.parametrize("spread", [128, 0])
def test_distinct_counts(spark, monkeypatch, spread):
    monkeypatch.setattr(profile, "BITMAP_SPREAD", spread)
    rows = [(i % 3, i * 7 % 400 - 50, f"s{i % 11}", i * 10**12) for i in range(900)]
    rows += [(None, 70_000, None, 5), (5, None, None, None), (0, None, "s1", 3)]
    df = table(spark, rows, "g int, id bigint, name string, wide bigint")
    found = profile.distinct_counts(df, {"ids": "id", "names": "name", "far": "wide"}, ["g"])
    got = {r["g"]: (r["ids"], r["names"], r["far"]) for r in found.collect()}
    for g in {r[0] for r in rows} - {5}:
        assert got[g] == tuple(len({r[i] for r in rows if r[0] == g and r[i] is not None}) for i in (1, 2, 3))
    assert 5 not in got  # a group without any value
    text = plan(found)
    assert "Expand" not in text and ("bitmap_construct_agg" in text) == (spread > 0)


def test_counts_build_the_facts_once(spark, tmp_path):
    rows = [(1, 10, "M05", 10), (1, 11, "M05", 10), (2, 12, "M06", 10), (2, 12, "M05", 10), (3, 13, "Z", 10)]
    table(spark, rows, "subject_id bigint, hadm_id bigint, icd_code string, icd_version int").write.parquet(f"{tmp_path}/f")
    rules = [CodeRule("ra", "10", "M0"), CodeRule("none", "10", "Q")]
    found = profile.cohort_counts(spark.read.parquet(f"{tmp_path}/f"), rules)
    assert {tuple(r) for r in found.collect()} == {("ra", 2, 3, 4), ("none", 0, 0, 0)}
    assert f"{tmp_path}/f" not in plan(found)
