"""Queries over readers, sinks, configuration and the small expressions: what is written comes back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions.numbers import clip, is_finite, rescale
from ..operators.cohort import cohort_members
from ..operators.compare import rule_table
from ..operators.confusion import binary_metrics
from ..operators.ranking import unpivot
from ..operators.thresholds import Rule, apply_rules, resolve_threshold
from ..session import settle, shared_folder
from ..sources import Tables, parse_config, write_report, write_result
from . import bindings as b
from .registry import query, r


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- readers and sinks -------------------------------------------------------

_ITEMS = ["R", "N"]
_READ = (
    "SELECT 'admissions' AS reader, count(*) AS n, count(DISTINCT o_custkey) AS subjects FROM orders UNION ALL"
    " SELECT 'diagnoses', count(*), count(DISTINCT o_custkey) FROM lineitem JOIN part ON l_partkey = p_partkey"
    " JOIN orders ON l_orderkey = o_orderkey UNION ALL"
    " SELECT 'lab_results', count(*), count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " WHERE l_returnflag IN ('R', 'N') UNION ALL"
    " SELECT 'patients', count(*), count(DISTINCT c_custkey) FROM customer"
)


def _hospital(spark, sf) -> Tables:
    """The sample tables under the names and columns that the readers ask for."""
    root = _folder(spark, "hospital")
    stays = b.admissions(spark, sf)
    lines = b.shipments(spark, sf).withColumnRenamed("feature", "itemid")
    for name, df in {
        "admissions": stays,
        "patients": b.patients(spark, sf),
        "diagnoses_icd": b.facts(spark, sf).select("subject_id", "hadm_id", "icd_code", "icd_version"),
        "labevents": lines.join(stays.select("hadm_id", "subject_id"), "hadm_id"),
    }.items():
        df.write.parquet(f"{root}/{name}")
    return Tables(spark, root, _ITEMS)


@query("named_readers", _READ)
def named_readers(spark, sf):
    """Rows and subjects of every named reader, required columns checked and items filtered."""
    tables = _hospital(spark, sf)
    counts = None
    for name in ("admissions", "diagnoses", "lab_results", "patients"):
        rows = getattr(tables, name)().select("subject_id").groupBy("subject_id").agg(F.expr("count(1) AS n"))
        part = rows.selectExpr(f"'{name}' AS reader", "n").groupBy("reader").agg(
            F.expr("sum(n) AS n"), F.expr("count(1) AS subjects")
        )
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query(
    "cached_readers",
    "SELECT o_custkey AS subject_id, count(*) AS stays, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS deaths"
    " FROM orders GROUP BY o_custkey",
)
def cached_readers(spark, sf):
    """Two groupings over one kept reader; its storage is freed before the result goes out."""
    tables = Tables(spark, sf, names={"admissions": "orders"})
    kept = tables.cached("orders").selectExpr("o_custkey AS subject_id", "o_orderstatus")
    stays = kept.groupBy("subject_id").agg(F.expr("count(1) AS stays"))
    deaths = kept.where("o_orderstatus = 'F'").groupBy("subject_id").agg(F.expr("count(1) AS deaths"))
    out, _ = settle(stays.join(deaths, "subject_id", "left").na.fill(0, ["deaths"]))
    tables.clear()
    return out


@query(
    "report_round_trip",
    "SELECT o_orderpriority AS priority, count(*) AS n, "
    + r("avg(o_totalprice)", "mean_price")
    + " FROM orders GROUP BY o_orderpriority",
)
def report_round_trip(spark, sf):
    """A report written as CSV and read again."""
    report = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.expr("count(1) AS n"), F.expr("avg(o_totalprice) AS mean_price")
    )
    path = write_report(report, _folder(spark, "report"))
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query(
    "result_round_trip",
    "SELECT 'price' AS method, 250000 AS cut, count(*) AS n,"
    " CAST(sum(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM orders",
)
def result_round_trip(spark, sf):
    """Metrics as JSON beside the predictions as parquet; both and the run's facts are read again."""
    scored = Rule("o_totalprice", 250000.0, "high").transform(b.table(spark, sf, "orders")).select("o_orderkey", "prediction")
    metrics = scored.selectExpr("'price' AS method", "prediction").groupBy("method").agg(F.expr("count(1) AS n"))
    paths = write_result(metrics, scored, _folder(spark, "result"), {"cut": 250000})
    read = spark.read.schema("method string, n bigint, run string").json(paths["metrics"])
    cut = json.loads(read.first()["run"])["cut"]
    hits = spark.read.parquet(paths["predictions"]).agg(F.expr("coalesce(sum(prediction), 0L) AS positives"))
    return read.selectExpr("method", f"{int(cut)} AS cut", "n", f"{int(hits.first()[0])}L AS positives")


# --- configuration -----------------------------------------------------------

_RANGES = {
    "cohorts": {
        "small": {"icd10_codes": ["M05-M14", "M01"]},
        "decimal": {"icd9_codes": ["714.0-714.2", "72x"]},
    }
}


@query(
    "code_range_members",
    "WITH f AS (SELECT l_suppkey AS subject_id, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey)"
    " SELECT DISTINCT 'small' AS cohort, subject_id FROM f WHERE s BETWEEN 5 AND 14 OR s = 1 UNION ALL"
    " SELECT DISTINCT 'decimal', subject_id FROM f WHERE s % 10 BETWEEN 0 AND 2 AND s >= 40 OR s BETWEEN 20 AND 29",
)
def code_range_members(spark, sf):
    """Cohorts whose configured codes are ranges and wildcards, over codes with letters and with dots."""
    lines = b.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    parts = b.table(spark, sf, "part").select("p_partkey", "p_size")
    coded = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_suppkey AS subject_id",
        "inline(array(struct('10' AS icd_version, concat('M', lpad(p_size, 2, '0')) AS icd_code),"
        " struct('9' AS icd_version, CASE WHEN p_size >= 40 THEN concat('714.', p_size % 10)"
        " WHEN p_size >= 20 THEN concat('7', p_size) ELSE '999' END AS icd_code)))",
    )
    return cohort_members(coded, parse_config(_RANGES).code_rules())


# --- expressions -------------------------------------------------------------


@query(
    "rescaled_values",
    "SELECT l_orderkey, l_linenumber, "
    + r("least(greatest(l_extendedprice, 5000), 60000)", "clipped")
    + ", "
    + r("least(greatest((l_quantity - 10) / 30.0, 0), 1)", "position")
    + " FROM lineitem",
)
def rescaled_values(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        clip("l_extendedprice", 5000.0, 60000.0).alias("clipped"),
        rescale("l_quantity", 10.0, 40.0).alias("position"),
    )


@query(
    "finite_statistics",
    "WITH x AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber = 1 THEN CAST('inf' AS DOUBLE) WHEN l_linenumber = 2"
    " THEN CAST('nan' AS DOUBLE) WHEN l_linenumber > 3 THEN CAST(l_quantity AS DOUBLE) END AS v FROM lineitem)"
    " SELECT flag, count(*) AS n, count(*) FILTER (WHERE isfinite(v)) AS finite, "
    + r("avg(abs(v - 25)) FILTER (WHERE isfinite(v))", "mean_distance")
    + ", "
    + r("stddev_pop(v) FILTER (WHERE isfinite(v))", "deviation")
    + " FROM x GROUP BY flag",
)
def finite_statistics(spark, sf):
    """Distances and population deviation of the finite values among infinite, undefined and missing ones."""
    rows = b.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS flag",
        "CASE WHEN l_linenumber = 1 THEN double('Infinity') WHEN l_linenumber = 2 THEN double('NaN')"
        " WHEN l_linenumber > 3 THEN CAST(l_quantity AS DOUBLE) END AS v",
    )
    finite = rows.withColumn("v", F.when(is_finite("v"), F.col("v")))
    return finite.groupBy("flag").agg(
        F.expr("count(1) AS n"),
        F.expr("count(v) AS finite"),
        F.expr("avg(abs(v - 25)) AS mean_distance"),
        F.expr("stddev_pop(v) AS deviation"),
    )


# --- rules side by side ------------------------------------------------------

_LIMITS = {
    "l_quantity": {"low": 10.0, "high": 30.0},
    "l_discount": 0.05,
    "l_tax": {"threshold": 0.04},
    "l_extendedprice": {"low": 20000.0},
}
_WAYS = {"l_quantity_min": "high", "l_discount": "low", "l_tax": "high", "l_extendedprice_max": "low"}
_SIDE = [("l_quantity", ">=", 30.0), ("l_discount", "<=", 0.05), ("l_tax", ">=", 0.04), ("l_extendedprice", "<=", 20000.0)]


@query(
    "rule_comparison",
    "WITH x AS (SELECT *, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{f} rule' AS method, '{f}' AS feature, CAST({t} AS DOUBLE) AS threshold, '{f} {sign} {t:.3f}' AS formula,"
        f" {r(f'avg(CAST({f} {sign} {t} AS INT)) FILTER (WHERE label = 1)', 'sensitivity')},"
        f" {r(f'avg(CAST(NOT ({f} {sign} {t}) AS INT)) FILTER (WHERE label = 0)', 'specificity')},"
        f" printf('%.4f', round(avg({f}) FILTER (WHERE label = 1) / avg({f}), 6)) AS importance FROM x"
        for f, sign, t in _SIDE
    ),
)
def rule_comparison(spark, sf):
    """Four rules with resolved limits: formulas, metrics and importances side by side."""
    rows = b.table(spark, sf, "lineitem").selectExpr(*[f"CAST({f} AS DOUBLE) AS {f}" for f, _, _ in _SIDE], "CAST(l_returnflag = 'R' AS INT) AS label")
    names = [f for f, _, _ in _SIDE]
    ratios = rows.selectExpr(
        *[f"round(avg(CASE WHEN label = 1 THEN {f} END) / avg({f}), 6) AS {f}" for f in names]
    ).first()
    rules = {}
    for asked, way in _WAYS.items():
        name = asked.removesuffix("_min").removesuffix("_max")
        threshold = resolve_threshold(_LIMITS, asked, way)
        rules[f"{name} rule"] = Rule(name, threshold, way, f"{name} rule", 3, {"weights": {name: ratios[name]}})
    flagged = apply_rules(rows, list(rules.values()))
    flags = [c for c in flagged.columns if c not in rows.columns]
    metrics = binary_metrics(unpivot(flagged, flags, ["label"], "method", "prediction", "int"), by=["method"])
    tables = [rule.as_table(rows) for rule in rules.values()]
    listed = tables[0]
    for one in tables[1:]:
        listed = listed.unionByName(one)
    return rule_table(metrics, listed).select(
        "method", "feature", "threshold", "formula", "sensitivity", "specificity", "importance"
    )
