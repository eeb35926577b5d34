"""Cohorts, panels and sources on hand-made tables."""

import datetime as dt

import pytest

from cohortspark.functions import as_timestamp, clip, hours_between, is_finite, ratio_text, rescale
from cohortspark.operators.cohort import (
    all_labels,
    cohort_labels,
    cohort_members,
    full_coalesce_join,
    match_codes,
    members_of,
    non_members,
    prepare_rules,
)
from cohortspark.operators.panel import (
    Obs,
    anchored_features,
    clean_observations,
    derived_features,
    feature_frame,
    lookback,
    min_tests,
    missing_flags,
    time_features,
)
from cohortspark.plans.dataset import create_dataset, labelled_frame, multi_cohort_labels
from cohortspark.sources import (
    CodeRule,
    Tables,
    default_config,
    expand_code,
    extract_tables,
    load_config,
    parse_config,
    read_table,
    write_report,
)
from pyspark.sql import functions as F

from helpers import column, plan, table

CODES = "subject_id bigint, hadm_id bigint, icd_code string, icd_version int"
LABS = "subject_id bigint, itemid int, charttime timestamp_ntz, valuenum double"
START = dt.datetime(2020, 1, 2, 8)

DIAGNOSES = [
    (1001, 2001, "714.0", 9),
    (1001, 2001, "555.0", 9),
    (1002, 2002, "250.00", 9),
    (1003, 2003, "M05", 10),
    (1003, 2003, "E11.9", 10),
    (1004, 2004, "K50", 10),
]
SETTINGS = parse_config(
    {
        "diseases": {
            "ra": {"icd9_codes": ["714.0", "714.1", "714.2"], "icd10_codes": ["M05", "M06"]},
            "crohn": {"icd9_codes": ["555.0-555.2"], "icd10_codes": ["K50"]},
            "dm2": {"icd9_codes": ["250.00", "250.02"], "icd10_codes": ["E11x"]},
        },
        "cbc_features": {
            "hemoglobin": {"itemids": [51222, 50811], "reference_range": {"low": 12, "high": 17.5}},
            "wbc": {"itemids": [51301, 51300]},
            "platelets": {"itemids": [51265]},
        },
        "feature_groups": {"core": ["hemoglobin", "wbc"]},
    }
)


def lab(subject, item, hours, value):
    return (subject, item, START + dt.timedelta(hours=hours), value)


LAB_ROWS = [
    lab(1001, 51222, 0, 13.5),
    lab(1001, 51301, 1, 8.2),
    lab(1001, 51265, 2, 250.0),
    lab(1002, 51222, 24, 11.0),
    lab(1002, 51265, 25, 180.0),
    lab(1003, 50811, 48, 14.2),
    lab(1004, 51300, 72, 6.8),
    lab(1004, 51265, 73, 200.0),
    lab(1004, 99999, 73, 1.0),
]


@pytest.fixture
def diagnoses(spark):
    return table(spark, DIAGNOSES, CODES)


def test_members_by_cohort(spark, diagnoses):
    rules = SETTINGS.code_rules()
    want = {"ra": [1001, 1003], "crohn": [1001, 1004], "dm2": [1002, 1003]}
    for cohort, ids in want.items():
        assert column(members_of(diagnoses, rules, cohort), "subject_id") == ids
    assert {(r[0], r[1]) for r in cohort_members(diagnoses, rules).collect()} == {
        (c, i) for c, ids in want.items() for i in ids
    }
    with pytest.raises(ValueError, match="crohn"):
        members_of(diagnoses, rules, "absent")


def test_dots_are_optional(spark):
    plain = table(spark, [(1, 1, "7140", 9), (2, 2, "714", 9)], CODES)
    rules = SETTINGS.code_rules(["ra"])
    assert column(members_of(plain, rules, "ra"), "subject_id") == [1]
    assert members_of(plain, rules, "ra", normalize=False).count() == 0


def test_system_can_be_ignored(spark):
    odd = table(spark, [(1, 1, "M05", 9)], CODES)
    rules = SETTINGS.code_rules(["ra"])
    assert members_of(odd, rules, "ra").count() == 0
    assert members_of(odd, rules, "ra", match_system=False).count() == 1


def test_overlapping_rules_match_once(spark):
    rules = [CodeRule("c", "9", "25"), CodeRule("c", "9", "250"), CodeRule("c", "9", "25")]
    assert prepare_rules(rules) == [("c", "9", "25")]
    facts = table(spark, [(1, 1, "250.1", 9)], CODES)
    assert match_codes(facts, rules).count() == 1


def test_match_is_a_broadcast_hash_join_and_prefixes_reach_the_scan(spark, diagnoses, tmp_path):
    text = plan(match_codes(diagnoses, SETTINGS.code_rules()))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Python" not in text
    diagnoses.write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    assert "StringStartsWith" in plan(match_codes(stored, SETTINGS.code_rules(), normalize=False))


def test_labels_cover_every_subject(spark, diagnoses):
    people = table(spark, [(i,) for i in (1001, 1002, 1003, 1004, 1005, 1005)], "subject_id bigint")
    rules = SETTINGS.code_rules()
    got = dict(cohort_labels(people, diagnoses, rules, "ra").collect())
    assert got == {1001: 1, 1002: 0, 1003: 1, 1004: 0, 1005: 0}
    long = all_labels(people, diagnoses, rules)
    assert long.count() == 15
    assert {(r[0], r[1]) for r in long.where("label = 1").collect()} == {
        (1001, "ra"), (1003, "ra"), (1001, "crohn"), (1004, "crohn"), (1002, "dm2"), (1003, "dm2"),
    }
    assert set(column(non_members(people, diagnoses, rules, "ra"), "subject_id")) == {1002, 1004, 1005}


def test_label_join_reuses_the_grouping(spark, diagnoses):
    people = spark.range(0, 5_000_000).selectExpr("id AS subject_id")
    text = plan(cohort_labels(people, diagnoses, SETTINGS.code_rules(), "ra"))
    assert text.count("Exchange hashpartitioning") + text.count(") Exchange") <= 4


def test_times_do_not_depend_on_the_session_zone(spark):
    rows = [(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30, 0, 5))]
    df = table(spark, rows, "a timestamp_ntz, b timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(hours_between(df, "a", "b").alias("h")).first()["h"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == pytest.approx(2 + 5 / 3.6e9, abs=1e-12)


def test_empty_rules_and_facts(spark, diagnoses):
    assert match_codes(diagnoses, []).count() == 0
    assert cohort_members(diagnoses.where("false"), SETTINGS.code_rules()).count() == 0


def test_code_ranges_keep_width():
    assert expand_code("714.0-714.2") == ["714.0", "714.1", "714.2"]
    assert expand_code("250.00-250.03") == ["250.00", "250.01", "250.02", "250.03"]
    assert expand_code("M05.x") == ["M05"]
    assert len(expand_code("714.0-714.9")) == 10


def test_config_files_are_merged_and_optional(tmp_path):
    assert load_config(str(tmp_path / "none")).cohorts == {}
    (tmp_path / "a.yaml").write_text("diseases:\n  x:\n    icd9_codes: ['1.0']\n")
    (tmp_path / "b.yaml").write_text("cbc_features:\n  hb:\n    itemids: [1]\n")
    config = load_config(str(tmp_path))
    assert config.item_ids() == [1]
    assert config.code_rules() == [CodeRule("x", "9", "1.0")]
    with pytest.raises(ValueError, match="'x'"):
        config.cohort("y")


def test_default_config(spark):
    config = default_config()
    assert len(config.cohorts) == 5 and len(config.features) == 15
    assert config.item_map(spark).count() == 19
    assert config.lit_thresholds(spark).where("cohort = 'crohns_disease' AND feature = 'hemoglobin'").first()["low"] == 10.0
    assert config.ref_ranges(spark).count() == 15 and config.feature_groups(spark).count() == 19


def test_panel_statistics(spark):
    rows = [lab(1, 51222, h, v) for h, v in ((0, 10.0), (1, 12.0), (2, 14.0))] + [lab(2, 51222, 0, 9.0)]
    frame = feature_frame(
        table(spark, rows, LABS), SETTINGS.item_map(spark), ["hemoglobin", "wbc"]
    )
    got = {r["subject_id"]: r.asDict() for r in frame.collect()}
    assert [got[1][c] for c in ("hemoglobin", "hemoglobin_min", "hemoglobin_max", "hemoglobin_std", "hemoglobin_count")] == [12, 10, 14, 2, 3]
    assert got[2]["hemoglobin_std"] is None and got[2]["wbc_count"] is None
    assert frame.columns[:3] == ["subject_id", "hemoglobin", "wbc"]


def test_lookback_counts_from_the_latest_test(spark):
    rows = [lab(1005, 51222, 24 * 40, 12.0), lab(1, 51222, 0, 1.0), lab(1, 51222, 24 * 30, 2.0), lab(1, 51222, 24 * 31, 3.0)]
    obs = table(spark, rows, LABS)
    kept = sorted((r["subject_id"], r["valuenum"]) for r in lookback(obs, 30).collect())
    assert kept == [(1, 2.0), (1, 3.0), (1005, 12.0)]
    assert lookback(obs, None).count() == 4
    anchors = table(spark, [(1, START + dt.timedelta(days=30))], "subject_id bigint, anchor_time timestamp_ntz")
    assert sorted(column(lookback(obs, 30, anchor=anchors), "valuenum")) == [1.0, 2.0]


def test_text_times_and_bad_times(spark):
    obs = table(spark, [(1, 51222, "2020-01-02 08:00:00", 1.0), (1, 51222, "2020-03-02 08:00:00", 2.0)],
                "subject_id bigint, itemid int, charttime string, valuenum double")
    assert column(lookback(obs, 30), "valuenum") == [2.0]
    bad = table(spark, [("noon",)], "t string")
    with pytest.raises(Exception, match="column t is not a time"):
        as_timestamp(bad, "t").collect()
    with pytest.raises(ValueError, match="not a time"):
        as_timestamp(table(spark, [(1,)], "t int"), "t")


def test_anchored_window_is_inclusive(spark):
    obs = table(spark, [(7, "hb", START + dt.timedelta(hours=h), float(h)) for h in (-1, 0, 24, 25)],
                "hadm_id bigint, feature string, charttime timestamp_ntz, valuenum double")
    stays = table(spark, [(7, START)], "hadm_id bigint, admittime timestamp_ntz")
    row = anchored_features(obs, stays, None, ["hb"]).first()
    assert (row["hb"], row["hb_count"]) == (12.0, 2)
    limits = table(spark, [("hb", 0.0, 24.5)], "feature string, low double, high double")
    first = time_features(obs, stays, limits).first()
    assert (first["baseline"], first["change"], first["hours_to_abnormal"]) == (0.0, 25.0, 25.0)


def test_min_tests(spark):
    df = table(spark, [(1, 3, None), (2, 3, 1), (3, None, 2)], "id int, a_count bigint, b_count bigint")
    assert column(min_tests(df, 2), "id") == [1, 3]
    assert column(min_tests(df, 3, "any"), "id") == [1, 2]
    assert min_tests(df, 1).count() == 3


def test_cleaning_and_derived(spark):
    df = table(spark, [("a", 5.0), ("a", -1.0), ("a", None), ("a", float("nan")), ("b", 500.0), ("a", 500.0)], "feature string, valuenum double")
    assert sorted(column(clean_observations(df, plausible={"a": (0, 100)}), "valuenum")) == [5.0, 500.0]
    wide = table(spark, [(6.0, 2.0), (1.0, 0.0), (None, 1.0)], "n double, l double")
    out = missing_flags(derived_features(wide, {"nlr": ("n", "l")}), ["n"])
    assert column(out, "nlr") == [3.0, None, None] and column(out, "n_missing") == [0, 0, 1]


def test_full_coalesce_join(spark):
    a = table(spark, [(1, 2.0), (2, 3.0)], "k int, a double")
    c = table(spark, [(2, 5), (3, 6)], "k int, c int")
    got = {r["k"]: (r["a"], r["c"]) for r in full_coalesce_join([a, c], ["k"]).collect()}
    assert got == {1: (2.0, None), 2: (3.0, 5), 3: (None, 6)}


def test_numbers(spark):
    df = table(spark, [(0.5,), (-3.0,), (9.0,), (None,), (float("inf"),)], "x double")
    assert column(df.select(clip("x").alias("c")), "c") == [0.5, 0.0, 1.0, None, 1.0]
    assert column(df.select(rescale("x", -1, 1).alias("c")), "c")[:2] == [0.75, 0.0]
    assert column(df.select(is_finite("x").alias("c")), "c") == [True, True, True, False, False]
    assert column(df.limit(1).select(ratio_text(F.lit(2), F.lit(5)).alias("c")), "c") == ["1:2.5"]
    times = table(spark, [(START, START + dt.timedelta(minutes=90))], "a timestamp_ntz, b timestamp_ntz")
    assert column(times.select(hours_between(times, "a", "b").alias("h")), "h") == [1.5]


@pytest.fixture
def star(spark, diagnoses, tmp_path):
    root = str(tmp_path / "star")
    table(spark, [(i, i + 1000, START) for i in (1001, 1002, 1003, 1004)],
          "subject_id bigint, hadm_id bigint, admittime timestamp_ntz").write.parquet(f"{root}/admissions")
    diagnoses.write.parquet(f"{root}/diagnoses_icd")
    table(spark, LAB_ROWS, LABS).coalesce(1).write.parquet(f"{root}/labevents.parquet")
    table(spark, [(1001, "F")], "subject_id bigint, gender string").write.parquet(f"{root}/patients")
    return root


def test_tables(spark, star):
    tables = Tables(spark, star, SETTINGS.item_ids())
    assert tables.admissions().count() == 4
    labs = tables.lab_results()
    assert labs.count() == 8 and "In(itemid" in plan(labs)
    with pytest.raises(FileNotFoundError, match="icustays"):
        tables.table("icustays")
    with pytest.raises(ValueError, match="nope"):
        tables.table("patients", ["nope"])
    assert tables.cached("patients").is_cached
    tables.clear()
    listed = {r["table"]: r["rows"] for r in tables.inventory().collect()}
    assert listed["admissions"] == 4 and listed["icustays"] == 0


def test_extract(spark, star, tmp_path):
    target = str(tmp_path / "out")
    names = ["labevents", "diagnoses_icd", "admissions"]
    extract_tables(spark, star, target, SETTINGS, names, dots=True)
    assert read_table(spark, target, "labevents").count() == 8
    assert read_table(spark, target, "diagnoses_icd").count() == 6
    extract_tables(spark, star, target, SETTINGS, names, filtered=False)
    assert read_table(spark, target, "labevents").count() == 9


def test_dataset(spark, star):
    tables = Tables(spark, star, SETTINGS.item_ids())
    joined = labelled_frame(tables, SETTINGS, "ra")
    assert "Python" not in plan(joined)
    assert dict(joined.select("subject_id", "label").collect()) == {1001: 1, 1002: 0, 1003: 1, 1004: 0}
    data = create_dataset(tables, SETTINGS, "ra", scale=None, fit_on="all").frame
    assert sorted(column(data, "hemoglobin")) == [11.0, 13.5, 13.5, 14.2]
    scaled = create_dataset(tables, SETTINGS, "ra", fit_on="all").frame
    assert scaled.selectExpr("abs(avg(hemoglobin)) < 1e-9 AS ok").first()["ok"]
    assert create_dataset(tables, SETTINGS, "ra", missing="drop", scale=None).frame.count() == 0
    assert multi_cohort_labels(tables, SETTINGS).count() == 12
    with pytest.raises(ValueError, match="known"):
        create_dataset(tables, SETTINGS, "zzz")


def test_report_file(spark, tmp_path):
    path = write_report(table(spark, [("a", 1)], "k string, n int"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(path).first()["k"] == "a"


def test_hot_subject_is_split_in_the_lookback_join(spark):
    """With broadcasts off, a subject holding most rows becomes a skewed join."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        obs = spark.range(0, 60_000, 1, 8).selectExpr(
            "CASE WHEN id % 3 > 0 THEN 7L ELSE id % 500 END AS subject_id",
            "CAST(id % 5 AS INT) AS itemid",
            "timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS charttime",
            "CAST(id AS DOUBLE) AS valuenum",
        )
        recent = lookback(obs, 1).groupBy("subject_id", "itemid").agg(F.expr("avg(valuenum) AS m"))
        assert recent.count() == 504
        recent.collect()
        assert "skew=true" in recent._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
