"""Queries over the star schema: cohorts, prevalence, availability, anchors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import prefix_of
from ..functions.numbers import safe_divide
from ..operators import profile
from ..operators.cohort import (
    all_labels,
    cohort_labels,
    cohort_members,
    full_coalesce_join,
    id_union,
    members_of,
    non_members,
    restrict_to,
)
from ..operators.panel import Obs, anchored_features, feature_frame, min_tests, time_features
from ..operators.prepare import Imputer, Scaler
from ..operators.views import encounter_view, fact_view, observation_view, star_view
from ..session import local_table, shared_folder, stage
from ..sources.bucketed import save_bucketed
from ..sources.sinks import extract_tables
from ..sources.tables import inventory, read_table
from . import bindings as b
from .dataset import cohort_frames
from .registry import query, r

RULES = b.CONFIG.code_rules()

FACTS = (
    "facts AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, p_brand AS icd_code,"
    " l_linestatus AS icd_version, l_linenumber AS seq_num, l_quantity AS valuenum, l_shipdate AS charttime"
    " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
)
_VALUES = (
    "('ones', 'F', 'Brand#1'), ('twos', 'O', 'Brand#2'), ('twos', 'F', 'Brand#21'),"
    " ('three', 'F', 'Brand#3'), ('five', 'F', 'Brand#5'), ('five', 'O', 'Brand#5'), ('nobody', 'F', 'Brand#99')"
)
MATCHED = (
    f"{FACTS}, rules(cohort, sys, prefix) AS (VALUES {_VALUES}),"
    " matched AS (SELECT cohort, f.* FROM facts f JOIN rules ON icd_version = sys AND starts_with(icd_code, prefix))"
)
COHORT_LIST = "cohorts AS (SELECT DISTINCT cohort FROM rules)"
MEMBERS = "members AS (SELECT DISTINCT cohort, subject_id, hadm_id FROM matched)"


@query("cohort_members", f"WITH {MATCHED} SELECT DISTINCT cohort, subject_id FROM matched")
def cohort_members_query(spark, sf):
    return cohort_members(b.facts(spark, sf), RULES)


@query(
    "cohort_members_any_system",
    f"WITH {FACTS}, rules(cohort, prefix) AS (SELECT DISTINCT cohort, prefix FROM (VALUES {_VALUES}) v(cohort, sys, prefix))"
    " SELECT DISTINCT cohort, subject_id FROM facts JOIN rules ON starts_with(icd_code, prefix)",
)
def cohort_members_any_system(spark, sf):
    return cohort_members(b.facts(spark, sf), RULES, normalize=False, match_system=False)


@query(
    "cohort_subject_list",
    f"WITH {MATCHED} SELECT DISTINCT subject_id FROM matched WHERE cohort = 'three'",
)
def cohort_subject_list(spark, sf):
    return members_of(b.facts(spark, sf), RULES, "three")


@query(
    "cohort_labels",
    f"WITH {MATCHED} SELECT DISTINCT o_custkey AS subject_id, CAST(o_custkey IN"
    " (SELECT subject_id FROM matched WHERE cohort = 'three') AS INT) AS label FROM orders",
)
def cohort_labels_query(spark, sf):
    return cohort_labels(b.admissions(spark, sf), b.facts(spark, sf), RULES, "three")


@query(
    "cohort_labels_all",
    f"WITH {MATCHED}, {COHORT_LIST}, s AS (SELECT DISTINCT o_custkey AS subject_id FROM orders),"
    " m AS (SELECT DISTINCT cohort, subject_id FROM matched)"
    " SELECT s.subject_id, c.cohort, CAST(m.subject_id IS NOT NULL AS INT) AS label"
    " FROM s CROSS JOIN cohorts c LEFT JOIN m ON m.cohort = c.cohort AND m.subject_id = s.subject_id",
)
def cohort_labels_all(spark, sf):
    return all_labels(b.admissions(spark, sf), b.facts(spark, sf), RULES)


@query(
    "non_members",
    f"WITH {MATCHED} SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_custkey NOT IN"
    " (SELECT subject_id FROM matched WHERE cohort = 'five')",
)
def non_members_query(spark, sf):
    return non_members(b.admissions(spark, sf), b.facts(spark, sf), RULES, "five")


@query(
    "cohort_union",
    f"WITH {MATCHED} SELECT DISTINCT subject_id FROM matched WHERE cohort IN ('three', 'five')",
)
def cohort_union(spark, sf):
    facts = b.facts(spark, sf)
    return id_union(
        members_of(facts, RULES, "three", ordered=False),
        members_of(facts, RULES, "five", ordered=False),
    )


@query(
    "restricted_admissions",
    f"WITH {MATCHED} SELECT o_custkey AS subject_id, o_orderkey AS hadm_id FROM orders WHERE (o_custkey, o_orderkey) IN"
    " (SELECT subject_id, hadm_id FROM matched WHERE cohort = 'three')",
)
def restricted_admissions(spark, sf):
    members = profile.cohort_encounters(b.facts(spark, sf), [x for x in RULES if x.cohort == "three"])
    return restrict_to(b.admissions(spark, sf), members, ["subject_id", "hadm_id"]).select(
        "subject_id", "hadm_id"
    )


COUNTS = (
    "counts AS (SELECT c.cohort, count(DISTINCT m.subject_id) AS subjects,"
    " count(DISTINCT m.hadm_id) AS encounters, count(m.subject_id) AS facts"
    " FROM cohorts c LEFT JOIN matched m ON m.cohort = c.cohort GROUP BY c.cohort)"
)


@query("cohort_counts", f"WITH {MATCHED}, {COHORT_LIST}, {COUNTS} SELECT * FROM counts")
def cohort_counts_query(spark, sf):
    return profile.cohort_counts(b.facts(spark, sf), RULES)


def _balance(spark, sf) -> DataFrame:
    totals = b.admissions(spark, sf).selectExpr(
        "count(DISTINCT subject_id) AS s", "count(DISTINCT hadm_id) AS e"
    ).first()
    return profile.class_balance(cohort_counts_query(spark, sf), totals["s"], totals["e"])


def _balance_sql() -> str:
    cells = []
    for level, col, total in (("subject", "subjects", "ts"), ("encounter", "encounters", "te")):
        cells += [
            f"{col} AS {level}_pos",
            f"{total} - {col} AS {level}_neg",
            f"CASE WHEN {col} > 0 THEN format('1:{{:.1f}}', ({total} - {col}) / {col}) ELSE 'N/A' END AS {level}_ratio",
            f"100.0 * {col} / {total} AS {level}_prevalence",
        ]
    return (
        f"WITH {MATCHED}, {COHORT_LIST}, {COUNTS},"
        " t AS (SELECT count(DISTINCT o_custkey) AS ts, count(DISTINCT o_orderkey) AS te FROM orders),"
        f" balance AS (SELECT cohort, {', '.join(cells)} FROM counts CROSS JOIN t)"
    )


@query(
    "class_balance",
    f"{_balance_sql()} SELECT cohort, subject_pos, subject_neg, subject_ratio, {r('subject_prevalence', 'subject_prevalence')},"
    f" encounter_pos, encounter_neg, encounter_ratio, {r('encounter_prevalence', 'encounter_prevalence')} FROM balance",
)
def class_balance_query(spark, sf):
    return _balance(spark, sf)


@query(
    "imbalance_strategy",
    f"{_balance_sql()} SELECT cohort, {r('encounter_prevalence', 'prevalence')}, CASE"
    " WHEN encounter_prevalence < 1 THEN 'SMOTE + class weights + stratified sampling'"
    " WHEN encounter_prevalence < 5 THEN 'Class weights + stratified sampling'"
    " WHEN encounter_prevalence < 15 THEN 'Stratified sampling (minimal intervention)'"
    " ELSE 'Standard sampling (well-balanced)' END AS strategy, subject_pos >= 1000 AS suitable FROM balance",
)
def imbalance_strategy_query(spark, sf):
    return profile.imbalance_strategy(_balance(spark, sf), "encounter_prevalence")


_SEGMENTS = ", ".join(
    f"100.0 * count(*) FILTER (WHERE c_mktsegment = '{s}') / count(*) AS pct_{s.lower()}"
    for s in b.SEGMENTS
)
DEMOGRAPHICS = (
    f"WITH {MATCHED}, {MEMBERS}, p AS (SELECT DISTINCT cohort, subject_id FROM members),"
    " a AS (SELECT cohort, count(*) AS subjects, avg(c_acctbal) AS mean_age, stddev_samp(c_acctbal) AS std_age,"
    f" median(c_acctbal) AS median_age, {_SEGMENTS}"
    " FROM p JOIN customer ON c_custkey = subject_id GROUP BY cohort),"
    " d AS (SELECT cohort, count(*) AS encounters, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS deaths"
    " FROM (SELECT DISTINCT cohort, hadm_id FROM members) JOIN orders ON o_orderkey = hadm_id GROUP BY cohort)"
)


def _demographics(spark, sf, cohorts=None):
    members = profile.cohort_encounters(b.facts(spark, sf), RULES)
    return profile.demographics(
        members, b.patients(spark, sf), b.admissions(spark, sf), group_values=b.SEGMENTS,
        cohorts=cohorts,
    )


@query(
    "cohort_demographics",
    f"{DEMOGRAPHICS} SELECT cohort, subjects, {r('mean_age', 'mean_age')}, {r('std_age', 'std_age')}, {r('median_age', 'median_age')},"
    + " ".join(f"{r(f'pct_{s.lower()}', f'pct_{s.lower()}')}," for s in b.SEGMENTS)
    + f" encounters, deaths, {r('100.0 * deaths / encounters', 'mortality_pct')} FROM a JOIN d USING (cohort)"
    + " UNION ALL SELECT x.cohort, 0, " + "NULL, " * (3 + len(b.SEGMENTS))
    + "0, 0, NULL FROM (SELECT DISTINCT cohort FROM rules) x WHERE x.cohort NOT IN (SELECT cohort FROM members)",
)
def cohort_demographics(spark, sf):
    return _demographics(spark, sf, b.COHORTS)


_FINDINGS = ["subjects", "mean_age", "pct_automobile", "mortality_pct"]


@query(
    "key_findings",
    f"{DEMOGRAPHICS}, w AS (SELECT *, 100.0 * deaths / encounters AS mortality_pct FROM a JOIN d USING (cohort)), long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS measure, cohort, CAST({f} AS DOUBLE) AS value FROM w" for f in _FINDINGS)
    + ") SELECT measure, arg_max(cohort, value) AS max_key, "
    + r("max(value)", "max_value")
    + ", arg_min(cohort, value) AS min_key, "
    + f"{r('min(value)', 'min_value')}, {r('avg(value)', 'mean_value')} FROM long GROUP BY measure",
)
def key_findings(spark, sf):
    return profile.extremes(_demographics(spark, sf), "cohort", _FINDINGS)


# --- availability and missingness --------------------------------------------


TESTS = (
    f"WITH {MATCHED}, {COHORT_LIST}, {COUNTS}, {MEMBERS},"
    " tests AS (SELECT m.cohort, m.subject_id, f.icd_code AS feature, count(*) AS n FROM facts f"
    " JOIN members m ON f.subject_id = m.subject_id AND f.hadm_id = m.hadm_id GROUP BY ALL),"
    " avail AS (SELECT cohort, count(*) AS with_tests, CAST(sum(n) AS BIGINT) AS tests, median(n) AS med FROM"
    " (SELECT cohort, subject_id, sum(n) AS n FROM tests GROUP BY ALL) GROUP BY cohort),"
    " availability AS (SELECT c.cohort, subjects, coalesce(with_tests, 0) AS with_tests,"
    " CASE WHEN subjects > 0 THEN 100.0 * with_tests / subjects ELSE 0 END AS pct_with_tests, coalesce(tests, 0) AS tests,"
    " coalesce(tests / with_tests, 0) AS mean_tests, coalesce(med, 0) AS median_tests"
    " FROM counts c LEFT JOIN avail a ON a.cohort = c.cohort)"
)
_GRID = ", ".join(f"('{x}')" for x in b.BRANDS)
MISSING = (
    f"{TESTS}, features(feature) AS (VALUES {_GRID}),"
    " pairs AS (SELECT cohort, feature, count(*) AS with_feature, CAST(sum(n) AS BIGINT) AS measurements FROM tests GROUP BY ALL),"
    " missing AS (SELECT c.cohort, f.feature, coalesce(p.with_feature, 0) AS with_feature,"
    " coalesce(100.0 * p.with_feature / a.with_tests, 0) AS pct_with,"
    " 100.0 - coalesce(100.0 * p.with_feature / a.with_tests, 0) AS pct_missing, coalesce(p.measurements, 0) AS measurements"
    " FROM cohorts c CROSS JOIN features f LEFT JOIN pairs p ON p.cohort = c.cohort AND p.feature = f.feature"
    " LEFT JOIN avail a ON a.cohort = c.cohort)"
)


def _stays_and_tests(spark, sf):
    """Cohort stays and their test counts; the joined facts are built once."""
    facts = stage(b.facts(spark, sf).select("subject_id", "hadm_id", "icd_code", "icd_version", "feature"))
    stays = profile.cohort_stays(facts, RULES)
    return stays, stage(profile.test_counts(facts, stays))


def _missing(spark, sf):
    return profile.missingness(_stays_and_tests(spark, sf)[1], b.COHORTS, b.BRANDS)


@query(
    "availability",
    f"{TESTS} SELECT cohort, subjects, with_tests, {r('pct_with_tests', 'pct_with_tests')}, tests,"
    f" {r('mean_tests', 'mean_tests')}, {r('median_tests', 'median_tests')} FROM availability",
)
def availability_query(spark, sf):
    stays, tests = _stays_and_tests(spark, sf)
    return profile.availability(tests, profile.stay_counts(stays, b.COHORTS))


@query(
    "coverage_assessment",
    f"{TESTS} SELECT cohort, with_tests, {r('pct_with_tests', 'pct_with_tests')}, pct_with_tests < 80 AS low_coverage,"
    " CASE WHEN with_tests >= 1000 AND pct_with_tests >= 70 THEN 'sufficient' WHEN with_tests >= 500 THEN 'marginal'"
    " ELSE 'insufficient' END AS sufficiency FROM availability",
)
def coverage_assessment_query(spark, sf):
    return profile.coverage_assessment(availability_query(spark, sf))


@query(
    "missingness_long",
    f"{MISSING} SELECT cohort, feature, with_feature, {r('pct_with', 'pct_with')}, {r('pct_missing', 'pct_missing')}, measurements FROM missing",
)
def missingness_long(spark, sf):
    return _missing(spark, sf)


@query(
    "missingness_pivot",
    f"{MISSING} SELECT cohort, "
    + ", ".join(r(f"max(pct_missing) FILTER (WHERE feature = '{x}')", f'"{x}"') for x in b.BRANDS)
    + " FROM missing GROUP BY cohort",
)
def missingness_pivot_query(spark, sf):
    return profile.missingness_pivot(_missing(spark, sf), b.BRANDS)


@query(
    "feature_completeness",
    f"{MISSING}, m AS (SELECT feature, avg(pct_with) AS pct_with, avg(pct_missing) AS pct_missing FROM missing GROUP BY feature)"
    f" SELECT feature, {r('pct_with', 'pct_with')}, {r('pct_missing', 'pct_missing')}, pct_missing > 50 AS mostly_missing,"
    " CASE WHEN pct_missing < 20 THEN 'Use as-is with simple imputation (median/mean)'"
    " WHEN pct_missing < 40 THEN 'Multiple imputation or create missing indicator'"
    " WHEN pct_missing < 60 THEN 'Optional feature with missingness indicator'"
    " ELSE 'May need to exclude from primary analysis' END AS strategy FROM m",
)
def feature_completeness_query(spark, sf):
    return profile.feature_completeness(_missing(spark, sf))


@query(
    "suitable_cohorts",
    f"WITH {MATCHED}, {COHORT_LIST}, {COUNTS} SELECT * FROM counts WHERE subjects >= 100 AND subjects < 1200",
)
def suitable_cohorts(spark, sf):
    return profile.report_where(cohort_counts_query(spark, sf), {"subjects": (100, 1200)})


@query(
    "rate_by_segment",
    "SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS hits,"
    f" {r('sum(CASE WHEN o_orderstatus = \'F\' THEN 1 ELSE 0 END) / count(*)', 'rate')}"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
def rate_by_segment(spark, sf):
    joined = b.admissions(spark, sf).join(b.patients(spark, sf), "subject_id")
    grouped = joined.groupBy(F.col("gender").alias("segment")).agg(
        F.expr("count(1) AS n"), F.expr("sum(hospital_expire_flag) AS hits")
    )
    return grouped.withColumn("rate", safe_divide("hits", "n"))


# --- anchors -----------------------------------------------------------------


_FLAGS = ["A", "N", "R"]
_STAT = {
    "mean": "avg(valuenum)",
    "min": "min(valuenum)",
    "max": "max(valuenum)",
    "std": "stddev_samp(valuenum)",
    "count": "count(valuenum)",
}
TIMED = (
    "timed AS (SELECT l_orderkey AS hadm_id, o_custkey AS subject_id, l_returnflag AS feature, l_quantity AS valuenum, l_shipdate,"
    " date_diff('microsecond', o_orderdate, l_shipdate) / 3600000000.0 AS hours"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def _anchor_cells() -> str:
    cells = []
    for s, e in _STAT.items():
        for f in _FLAGS:
            name = f if s == "mean" else f"{f}_{s}"
            cell = f"{e} FILTER (WHERE feature = '{f}')"
            cells.append(f"nullif({cell}, 0) AS {name}" if s == "count" else r(cell, name))
    return ", ".join(cells)


@query(
    "anchor_window",
    f"WITH {TIMED} SELECT hadm_id, {_anchor_cells()} FROM timed WHERE hours BETWEEN 0 AND 1440 GROUP BY hadm_id",
)
def anchor_window(spark, sf):
    return anchored_features(
        b.shipments(spark, sf), b.admissions(spark, sf), None, _FLAGS, hours=(0.0, 1440.0)
    )


@query(
    "bucketed_anchor_window",
    f"WITH {TIMED} SELECT hadm_id, {_anchor_cells()} FROM timed WHERE hours BETWEEN 0 AND 1440 GROUP BY hadm_id",
)
def bucketed_anchor_window(spark, sf):
    """The anchored features from observations and encounters that are stored by encounter."""
    name = uuid.uuid4().hex
    anchors = save_bucketed(b.admissions(spark, sf), f"stays_{name}", ["hadm_id"], split_hot=False).even
    stored = save_bucketed(b.shipments(spark, sf), f"lines_{name}", ["hadm_id"])
    return stored.apply(
        lambda part, colocated: anchored_features(
            part, anchors, None, _FLAGS, hours=(0.0, 1440.0), colocated=colocated
        )
    )


TIMELINE = (
    f"WITH {MATCHED}, {TIMED}, line AS (SELECT m.cohort, t.hours FROM timed t JOIN"
    " (SELECT DISTINCT cohort, subject_id FROM matched) m ON m.subject_id = t.subject_id"
    " WHERE hours BETWEEN -2400 AND 16800)"
)


def _timeline(spark, sf):
    facts = b.facts(spark, sf)
    members = profile.cohort_encounters(facts, RULES)
    return stage(
        profile.timeline(facts, b.admissions(spark, sf).drop("subject_id"), members, band=(-2400.0, 16800.0))
    )


@query(
    "timeline_hist",
    f"{TIMELINE}, s AS (SELECT cohort, min(hours) AS lo, max(hours) AS hi FROM line GROUP BY cohort),"
    " p AS (SELECT cohort, lo, hi, least(CAST(floor((hours - lo) / (hi - lo) * 50) AS INT) + 1, 50) AS bin FROM line JOIN s USING (cohort))"
    f" SELECT cohort, bin, {r('lo + (hi - lo) * (bin - 1) / 50', 'low')}, {r('lo + (hi - lo) * bin / 50', 'high')}, count(*) AS n"
    " FROM p GROUP BY cohort, lo, hi, bin",
)
def timeline_hist(spark, sf):
    return profile.histogram(_timeline(spark, sf), "hours", 50, ["cohort"])


@query(
    "timeline_summary",
    f"{TIMELINE} SELECT cohort, count(*) AS n, {r('avg(hours)', 'mean')}, {r('median(hours)', 'median')} FROM line GROUP BY cohort",
)
def timeline_summary(spark, sf):
    return profile.describe(_timeline(spark, sf), "hours", ["cohort"]).select("cohort", "n", "mean", "median")


@query(
    "time_features",
    f"WITH {TIMED}, k AS (SELECT *, valuenum < 10 OR valuenum > 40 AS odd FROM timed WHERE hours >= 0)"
    " SELECT hadm_id, feature,"
    f" {r('(arg_min(valuenum, (hours, valuenum)) FILTER (WHERE hours <= 2400))', 'baseline')},"
    f" {r('(arg_max(valuenum, (hours, valuenum)) FILTER (WHERE hours <= 9600)) - (arg_min(valuenum, (hours, valuenum)) FILTER (WHERE hours <= 2400))', 'change')},"
    f" {r('min(hours) FILTER (WHERE odd)', 'hours_to_abnormal')}, {r('min(valuenum)', 'min_value')}, {r('max(valuenum)', 'max_value')}"
    " FROM k GROUP BY hadm_id, feature",
)
def time_features_query(spark, sf):
    limits = local_table(spark, [(f, 10.0, 40.0) for f in _FLAGS], "feature string, low double, high double")
    return time_features(
        b.shipments(spark, sf), b.admissions(spark, sf), limits, baseline_hours=2400.0, change_hours=9600.0
    )


# --- lookup joins ------------------------------------------------------------


@query(
    "fact_title_join",
    "SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, p_brand AS icd_code, p_name AS long_title, o_orderdate AS admittime"
    " FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey",
)
def fact_title_join(spark, sf):
    """Facts with their titles and encounters, sorted by encounter and position."""
    lines = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS hadm_id", "l_linenumber AS seq_num", "l_partkey AS part")
    titles = b.table(spark, sf, "part").selectExpr("p_partkey AS part", "p_brand AS icd_code", "p_name AS long_title")
    stays = b.table(spark, sf, "orders").selectExpr("o_orderkey AS hadm_id", "o_orderdate AS admittime")
    return fact_view(lines, titles, stays, ["part"], ordered=True).drop("part")


@query(
    "primary_fact_join",
    "SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, p_brand AS icd_code FROM orders LEFT JOIN lineitem"
    " ON l_orderkey = o_orderkey AND l_linenumber = 1 LEFT JOIN part ON l_partkey = p_partkey",
)
def primary_fact_join(spark, sf):
    facts = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS hadm_id", "l_linenumber AS seq_num", "l_partkey AS part")
    titles = b.table(spark, sf, "part").selectExpr("p_partkey AS part", "p_brand AS icd_code")
    stays = b.admissions(spark, sf).select("hadm_id", "subject_id")
    return encounter_view(stays, None, facts, titles, title_keys=["part"]).select("hadm_id", "subject_id", "icd_code")


@query(
    "subject_observations",
    "SELECT user_id AS subject_id, event_type AS itemid, upper(event_type) AS label, ts AS charttime, value AS valuenum"
    " FROM events WHERE user_id = (SELECT min(user_id) FROM events)",
)
def subject_observations(spark, sf):
    """All observations of one subject with their labels, in time order."""
    events = b.events(spark, sf)
    first = events.agg(F.min("user_id")).first()[0]
    obs = events.selectExpr("user_id AS subject_id", "event_type AS itemid", "ts AS charttime", "value AS valuenum")
    labels = events.selectExpr("event_type AS itemid", "upper(event_type) AS label").distinct()
    return observation_view(obs, labels, first).select("subject_id", "itemid", "label", "charttime", "valuenum")


@query(
    "star_join_rows",
    "SELECT l.l_orderkey AS hadm_id, l.l_linenumber AS line, l.l_quantity AS valuenum, p.p_type AS label, o_custkey AS subject_id,"
    " c_mktsegment AS gender, f.l_partkey AS part, q.p_brand AS icd_code FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey"
    " LEFT JOIN orders ON l.l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"
    " LEFT JOIN lineitem f ON f.l_orderkey = l.l_orderkey AND f.l_linenumber = 1 LEFT JOIN part q ON f.l_partkey = q.p_partkey",
)
def star_join_rows(spark, sf):
    """Every observation with item, encounter, subject, and the encounter's primary code."""
    lines, parts = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    return star_view(
        lines.selectExpr("l_orderkey AS hadm_id", "l_linenumber AS line", "l_quantity AS valuenum", "l_partkey AS itemid"),
        parts.selectExpr("p_partkey AS itemid", "p_type AS label"),
        b.table(spark, sf, "orders").selectExpr("o_orderkey AS hadm_id", "o_custkey AS subject_id"),
        b.table(spark, sf, "customer").selectExpr("c_custkey AS subject_id", "c_mktsegment AS gender"),
        lines.selectExpr("l_orderkey AS hadm_id", "l_linenumber AS seq_num", "l_partkey AS part"),
        parts.selectExpr("p_partkey AS part", "p_brand AS icd_code"),
        title_keys=["part"],
    ).drop("itemid")


@query(
    "star_join",
    f"SELECT c_mktsegment AS segment, n_name AS nation, p_brand AS brand, count(*) AS n, {r('avg(l_quantity)', 'quantity')}"
    " FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey"
    " LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)
def star_join(spark, sf):
    """Facts to lookups, encounter and subject, each a left join on its key."""
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = b.table(spark, sf, "part").select("p_partkey", "p_brand")
    people = b.table(spark, sf, "customer").join(
        b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    stays = b.table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(
            stays.select("o_orderkey", "c_mktsegment", "n_name"),
            F.col("l_orderkey") == F.col("o_orderkey"),
            "left",
        )
        .groupBy(
            F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("p_brand").alias("brand")
        )
        .agg(F.expr("count(1) AS n"), F.expr("avg(l_quantity) AS quantity"))
    )


@query(
    "coalesced_full_join",
    "SELECT coalesce(a.k, b.k, p.k) AS k, n_f, n_o, n_p FROM (SELECT o_custkey AS k, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a"
    " FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k"
    " FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n_p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON p.k = coalesce(a.k, b.k)",
)
def coalesced_full_join(spark, sf):
    orders = b.table(spark, sf, "orders").selectExpr("o_custkey AS k", "o_orderstatus AS s")
    frames = [
        orders.where(f"s = '{s}'").groupBy("k").agg(F.expr(f"count(1) AS n_{s.lower()}"))
        for s in ("F", "O", "P")
    ]
    return full_coalesce_join(frames, ["k"])


_AUDIT = ["Brand#1", "Brand#.2", "Brand#25"]


@query(
    "code_audit",
    f"WITH {FACTS} SELECT 'system' AS kind, icd_version AS item, count(*) AS n FROM facts GROUP BY 2"
    " UNION ALL SELECT 'prefix', substr(icd_code, 1, 3), count(*) FROM facts GROUP BY 2"
    + "".join(
        f" UNION ALL SELECT * FROM (SELECT '{kind}', '{p}', count(*) AS n FROM facts WHERE starts_with(icd_code, '{x}')) WHERE n > 0"
        for p in _AUDIT
        for kind, x in (("as_written", p), ("without_dots", p.replace(".", "")))
    ),
)
def code_audit_query(spark, sf):
    return profile.code_audit(b.facts(spark, sf), _AUDIT)


@query(
    "prefix_counts",
    "SELECT substr(o_orderpriority, 1, 1) AS prefix, count(*) AS n FROM orders GROUP BY 1",
)
def prefix_counts(spark, sf):
    orders = b.table(spark, sf, "orders").select(prefix_of("o_orderpriority", 1).alias("prefix"))
    return profile.value_counts(orders, "prefix")


# --- whole chain -------------------------------------------------------------


# the items whose counts the assembled data set requires; with all, few subjects would have enough of each
_DATASET_FEATURES = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6"]


def _dataset_sql() -> str:
    # statistics of six codes over each subject's last 900 days, labelled by cohort
    cells, names = [], []
    for s, e in _STAT.items():
        for f in _DATASET_FEATURES:
            n = f if s == "mean" else f"{f}_{s}"
            cell = f"{e} FILTER (WHERE icd_code = '{f}')"
            cells.append((f"nullif({cell}, 0)" if s == "count" else cell) + f' AS "{n}"')
            names.append(f'"{n}"')
    counts = " AND ".join(f'("{f}_count" IS NULL OR "{f}_count" >= 2)' for f in _DATASET_FEATURES)
    chosen = ", ".join(f"'{f}'" for f in _DATASET_FEATURES)
    fills = ", ".join(f"median({n}) AS {n}" for n in names)
    filled = ", ".join(f"coalesce(CAST(j.{n} AS DOUBLE), f.{n}) AS {n}" for n in names)
    params = ", ".join(f"avg({n}) AS a{i}, stddev_pop({n}) AS b{i}" for i, n in enumerate(names))
    scaled = ", ".join(
        r(f"(i.{n} - a{i}) / CASE WHEN b{i} <= 1e-12 * abs(a{i}) THEN 1 ELSE b{i} END", n)
        for i, n in enumerate(names)
    )
    return (
        f"WITH {MATCHED}, known AS (SELECT * FROM facts WHERE icd_code IN ({chosen})),"
        " ends AS (SELECT subject_id, max(charttime) AS mx FROM known GROUP BY subject_id),"
        " recent AS (SELECT k.* FROM known k JOIN ends e ON e.subject_id = k.subject_id"
        " WHERE charttime >= mx - INTERVAL 900 DAY),"
        f" wide AS (SELECT subject_id, {', '.join(cells)} FROM recent GROUP BY subject_id),"
        " joined AS (SELECT w.*, CAST(w.subject_id IN (SELECT subject_id FROM matched WHERE cohort = 'five') AS INT) AS label"
        f" FROM wide w WHERE {counts}),"
        f" f AS (SELECT {fills} FROM joined), i AS (SELECT j.subject_id, j.label, {filled} FROM joined j CROSS JOIN f),"
        f" s AS (SELECT {params} FROM i) SELECT i.subject_id, i.label, {scaled} FROM i CROSS JOIN s"
    )


def _cohort_datasets_sql() -> str:
    cells = ", ".join(f"avg(valuenum) FILTER (WHERE icd_code = '{f}') AS \"{f}\"" for f in b.BRANDS)
    names = [f'"{f}"' for f in b.BRANDS]
    chosen = ", ".join(f"'{f}'" for f in b.BRANDS)
    fills = ", ".join(f"median({n}) AS {n}" for n in names)
    return (
        f"WITH {MATCHED}, {COHORT_LIST}, known AS (SELECT * FROM facts WHERE icd_code IN ({chosen})),"
        f" wide AS (SELECT subject_id, {cells} FROM known GROUP BY subject_id),"
        " hits AS (SELECT DISTINCT cohort, subject_id FROM matched),"
        " people AS (SELECT DISTINCT o_custkey AS subject_id FROM orders),"
        f" f AS (SELECT {fills} FROM wide JOIN people USING (subject_id))"
        " SELECT w.subject_id, c.cohort, CAST(h.subject_id IS NOT NULL AS INT) AS label, "
        + ", ".join(r(f"coalesce(w.{n}, f.{n})", n) for n in names)
        + " FROM wide w JOIN people USING (subject_id) CROSS JOIN cohorts c CROSS JOIN f"
        " LEFT JOIN hits h ON h.subject_id = w.subject_id AND h.cohort = c.cohort"
    )


@query("cohort_datasets", _cohort_datasets_sql())
def cohort_datasets(spark, sf):
    """Labelled, imputed features for every cohort from one pass over the observations."""
    facts = b.facts(spark, sf)
    items = local_table(spark, [(x, x) for x in b.BRANDS], "itemid string, feature string")
    wide = feature_frame(
        facts.drop("feature"), items, b.BRANDS, None,
        Obs("subject_id", "icd_code", "charttime", "valuenum"), ("mean",),
    )
    return cohort_frames(wide, all_labels(b.admissions(spark, sf), facts, RULES), fit_on="all", scale=None).frame


@query("dataset_assembly", _dataset_sql())
def dataset_assembly(spark, sf):
    facts = b.facts(spark, sf)
    items = local_table(spark, [(x, x) for x in _DATASET_FEATURES], "itemid string, feature string")
    wide = feature_frame(
        facts.drop("feature"), items, _DATASET_FEATURES, 900, Obs("subject_id", "icd_code", "charttime", "valuenum")
    )
    labels = cohort_labels(b.admissions(spark, sf), facts, RULES, "five")
    joined = stage(min_tests(wide, 2).join(labels, "subject_id"))
    filled = stage(Imputer("median").fit_transform(joined))
    return Scaler("standard").fit_transform(filled)


_INVENTORY = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "absent",
]


@query(
    "table_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST(1 AS BIGINT) AS files FROM {t}" for t in _INVENTORY[:-1]
    )
    + " UNION ALL SELECT 'absent', 0, 0",
)
def table_inventory(spark, sf):
    return inventory(spark, sf, _INVENTORY).drop("bytes")


_KEPT = " OR ".join(f"starts_with(replace(icd_code, '.', ''), '{p}')" for p in sorted({x.prefix for x in RULES}))


@query(
    "extract_filtered",
    f"WITH {FACTS}, dotted AS (SELECT CASE WHEN hadm_id % 2 = 0 THEN substr(icd_code, 1, 7) || '.' || substr(icd_code, 8)"
    " ELSE icd_code END AS icd_code FROM facts),"
    " labs AS (SELECT CASE WHEN user_id % 3 = 0 THEN event_type || '_other' ELSE event_type END AS itemid FROM events)"
    f" SELECT 'code' AS kind, icd_code AS item, count(*) AS n FROM dotted WHERE {_KEPT} GROUP BY 2"
    f" UNION ALL SELECT 'lab', itemid, count(*) FROM labs WHERE itemid IN ({', '.join(repr(i) for i in b.CONFIG.item_ids())}) GROUP BY 2",
)
def extract_filtered(spark, sf):
    """Items and codes by rule, codes stored with and without their dot."""
    source, target = (f"{shared_folder(spark)}/{n}-{uuid.uuid4().hex}" for n in ("source", "extract"))
    b.facts(spark, sf).selectExpr(
        "subject_id", "hadm_id", "seq_num", "icd_version",
        "CASE WHEN hadm_id % 2 = 0 THEN concat(substr(icd_code, 1, 7), '.', substr(icd_code, 8)) ELSE icd_code END AS icd_code",
    ).write.parquet(f"{source}/diagnoses_icd")
    b.events(spark, sf).selectExpr(
        "user_id AS subject_id", "ts AS charttime", "value AS valuenum", "user_id AS hadm_id",
        "CASE WHEN user_id % 3 = 0 THEN concat(event_type, '_other') ELSE event_type END AS itemid",
    ).write.parquet(f"{source}/labevents")
    paths = extract_tables(spark, source, target, b.CONFIG, ["labevents", "diagnoses_icd"])
    parts = [
        spark.read.parquet(paths[t]).groupBy(F.lit(kind).alias("kind"), F.col(c).alias("item")).agg(F.count("*").alias("n"))
        for t, kind, c in (("diagnoses_icd", "code", "icd_code"), ("labevents", "lab", "itemid"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "extract_round_trip",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
)
def extract_round_trip(spark, sf):
    target = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    extract_tables(spark, sf, target, b.CONFIG, ["orders"])
    return read_table(spark, target, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
