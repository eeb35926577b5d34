"""Prevalence, availability, missingness and data-quality reports.

Each report takes all cohorts and features in one job. The reports are small, but
everything before the last grouping is as large as the data and stays distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import t_two_sided
from ..session import local_table, null_safe, settle, stage
from ..sources.config import CodeRule
from .cohort import match_codes
from .panel import add_hours
from .ranking import q, qs, quantiles, text, unpivot

# Advice by upper limit of the subject prevalence and of the mean
# missing share (percent), the last entry having no limit; report limits.
PREVALENCE_ADVICE = [
    (1, "SMOTE + class weights + stratified sampling"),
    (5, "Class weights + stratified sampling"),
    (15, "Stratified sampling (minimal intervention)"),
    (None, "Standard sampling (well-balanced)"),
]
MISSING_ADVICE = [
    (20, "Use as-is with simple imputation (median/mean)"),
    (40, "Multiple imputation or create missing indicator"),
    (60, "Optional feature with missingness indicator"),
    (None, "May need to exclude from primary analysis"),
]
SUITABLE_SUBJECTS = 1000
LOW_COVERAGE = 80
SUFFICIENT = (1000, 70)
MARGINAL_SUBJECTS = 500
MOSTLY_MISSING = 50

_PCT = "CASE WHEN {b} > 0 THEN 100D * ({a}) / ({b}) ELSE 0D END"


def _advice(value: str, table: Sequence[tuple]) -> str:
    """SQL: the text of the first limit above ``value``."""
    cases = " ".join(f"WHEN {value} < {limit} THEN {text(t)}" for limit, t in table if limit is not None)
    return f"CASE {cases} ELSE {text(table[-1][1])} END"


def _known(value: str) -> str:
    return f"{q(value)} IS NOT NULL AND NOT isnan(CAST({q(value)} AS DOUBLE))"


# --- cohorts -----------------------------------------------------------------


def cohort_encounters(
    facts: DataFrame,
    rules: Sequence[CodeRule],
    subject: str = "subject_id",
    encounter: str = "hadm_id",
    **match,
) -> DataFrame:
    """Distinct (cohort, subject, encounter)."""
    return match_codes(facts, rules, **match).select("cohort", subject, encounter).distinct()


def cohort_stays(
    facts: DataFrame,
    rules: Sequence[CodeRule],
    subject: str = "subject_id",
    encounter: str = "hadm_id",
    **match,
) -> DataFrame:
    """(cohort, subject, encounter, facts), written once: what counts, availability and missingness need of
    the matching facts."""
    matched = match_codes(facts, rules, **match)
    return stage(matched.groupBy("cohort", subject, encounter).agg(F.expr("count(1) AS facts")))


# Bitmaps pay while the ids of a column spread over at most this many times their number.
BITMAP_SPREAD = 128


def distinct_counts(df: DataFrame, columns: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Exact numbers of distinct non-null values per group: one column of ``columns`` (result name to
    column) each.

    Integer ids that lie densely are set as bits of bitmaps of 32 768 ids, so a task sends at most 4 kB
    for each of these ranges and group, whatever the rows. Sparse ids and other types are grouped. Neither way
    multiplies the rows by the columns before they are combined. ``df`` is scanned once
    for the spread and once for each way; ``stage`` it if it is costly.
    """
    by = list(by)
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    integral = [n for n, c in columns.items() if kinds[c] in whole]
    dense = []
    if integral:
        span = df.selectExpr(
            "count(1) AS rows",
            *[f"CAST(max({q(columns[n])}) AS DOUBLE) - min({q(columns[n])}) AS s{i}" for i, n in enumerate(integral)],
        ).first()
        dense = [n for i, n in enumerate(integral) if (span[f"s{i}"] or 0) <= BITMAP_SPREAD * span["rows"]]
    parts = []
    if dense:
        ids = ", ".join(f"struct({text(n)} AS name, CAST({q(columns[n])} AS BIGINT) AS id)" for n in dense)
        parts.append(
            df.selectExpr(*qs(by), f"inline(array({ids}))")
            .where("id IS NOT NULL")
            .groupBy(*by, "name", F.expr("bitmap_bucket_number(id) AS bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id)) AS bits"))
            .groupBy(*by, "name")
            .agg(F.expr("sum(bitmap_count(bits)) AS n"))
        )
    for n in columns:
        if n not in dense:
            known = df.where(f"{q(columns[n])} IS NOT NULL").groupBy(*by, columns[n]).agg(F.lit(1).alias("one"))
            parts.append(known.groupBy(*by).agg(F.expr("count(1) AS n")).selectExpr(*qs(by), f"{text(n)} AS name", "n"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy(*by).agg(
        *[F.expr(f"coalesce(max(CASE WHEN name = {text(n)} THEN n END), 0) AS {q(n)}") for n in columns]
    )


def stay_counts(
    stays: DataFrame, cohorts: Sequence[str], subject: str = "subject_id", encounter: str = "hadm_id"
) -> DataFrame:
    """(cohort, subjects, encounters, facts) from ``cohort_stays``; cohorts without facts have zeros."""
    every = local_table(stays.sparkSession, [(c,) for c in sorted(set(cohorts))], "cohort string")
    sizes = stays.groupBy("cohort").agg(F.expr("sum(facts) AS facts"))
    people = distinct_counts(stays, {"subjects": subject, "encounters": encounter}, ["cohort"])
    return (
        every.join(people, "cohort", "left")
        .join(sizes, "cohort", "left")
        .na.fill(0)
        .select("cohort", "subjects", "encounters", "facts")
    )


def cohort_counts(
    facts: DataFrame,
    rules: Sequence[CodeRule],
    subject: str = "subject_id",
    encounter: str = "hadm_id",
    approx: bool = False,
    **match,
) -> DataFrame:
    """(cohort, subjects, encounters, facts); cohorts without facts have zeros. One pass over the facts."""
    cohorts = sorted({r.cohort for r in rules})
    if not approx:
        return stay_counts(cohort_stays(facts, rules, subject, encounter, **match), cohorts, subject, encounter)
    found = match_codes(facts, rules, **match).groupBy("cohort").agg(
        F.expr(f"approx_count_distinct({q(subject)}) AS subjects"),
        F.expr(f"approx_count_distinct({q(encounter)}) AS encounters"),
        F.expr("count(1) AS facts"),
    )
    every = local_table(facts.sparkSession, [(c,) for c in cohorts], "cohort string")
    return every.join(found, "cohort", "left").na.fill(0)


def demographics(
    members: DataFrame,
    people: DataFrame,
    encounters: DataFrame | None = None,
    subject: str = "subject_id",
    encounter: str = "hadm_id",
    age: str = "anchor_age",
    group: str = "gender",
    group_values: Sequence[str] = ("F", "M"),
    death: str = "hospital_expire_flag",
    cohorts: Sequence[str] | None = None,
) -> DataFrame:
    """Per cohort: subjects, encounters, mean / median / sample deviation of age,
    percent per group value, deaths and deaths per hundred encounters.

    ``members`` is (cohort, subject, encounter). Percentages are of all subjects of
    the cohort, also those absent from ``people``. Each of ``cohorts`` has a row, with zero
    counts and null statistics if it has no members; without the list only those with members do.
    """
    members = stage(members.select("cohort", subject, encounter).distinct())
    people_of = members.select("cohort", subject).distinct()
    joined = stage(people_of.join(people.select(subject, age, group), subject, "left"))
    per_cohort = joined.groupBy("cohort").agg(
        F.expr("count(1) AS subjects"),
        F.expr(f"avg({q(age)}) AS mean_age"),
        F.expr(f"stddev_samp({q(age)}) AS std_age"),
        *[
            F.expr(f"100D * count_if({q(group)} = {text(v)}) / count(1) AS `pct_{v.lower()}`")
            for v in group_values
        ],
    )
    middle = quantiles(joined, age, {"median_age": 0.5}, ["cohort"]).drop("n")
    out = per_cohort.join(middle, "cohort", "left")
    if encounters is not None:
        stays = members.select("cohort", encounter).distinct()
        deaths = (
            stays.join(encounters.select(encounter, death), encounter, "left")
            .groupBy("cohort")
            .agg(F.expr("count(1) AS encounters"), F.expr(f"coalesce(sum({q(death)}), 0) AS deaths"))
            .selectExpr("*", f"{_PCT.format(a='deaths', b='encounters')} AS mortality_pct")
        )
        out = out.join(deaths, "cohort", "left")
    if cohorts is not None:
        every = local_table(members.sparkSession, [(c,) for c in sorted(set(cohorts))], "cohort string")
        counts = [c for c in ("subjects", "encounters", "deaths") if c in out.columns]
        out = every.join(out, "cohort", "left").na.fill(0, counts)
    return out


def class_balance(counts: DataFrame, n_subjects: int, n_encounters: int) -> DataFrame:
    """Positives, negatives, ``1:n`` ratio and prevalence per cohort at subject and
    encounter level, from ``cohort_counts`` and the two population sizes."""
    parts = ["cohort"]
    for level, column, total in (
        ("subject", "subjects", n_subjects),
        ("encounter", "encounters", n_encounters),
    ):
        parts += [
            f"{column} AS {level}_pos",
            f"{total}L - {column} AS {level}_neg",
            f"CASE WHEN {column} > 0 THEN format_string('1:%.1f', CAST({total}L - {column} AS DOUBLE) / {column})"
            f" ELSE 'N/A' END AS {level}_ratio",
            f"{_PCT.format(a=column, b=f'{total}L')} AS {level}_prevalence",
        ]
    return counts.selectExpr(*parts)


def imbalance_strategy(balance: DataFrame, prevalence: str = "subject_prevalence") -> DataFrame:
    """Sampling advice by prevalence and whether the cohort is large enough."""
    p = q(prevalence)
    return balance.selectExpr(
        "cohort",
        f"{p} AS prevalence",
        f"{_advice(p, PREVALENCE_ADVICE)} AS strategy",
        f"subject_pos >= {SUITABLE_SUBJECTS} AS suitable",
    )


def extremes(report: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(measure, max_key, max_value, min_key, min_value, mean_value) for columns of a
    report table; the smaller key wins a tie."""
    long = unpivot(report, columns, [key], "measure", "value").where("value IS NOT NULL")
    k = q(key)
    return long.groupBy("measure").agg(
        F.expr(f"min(struct(-value AS v, {k} AS k)).k AS max_key"),
        F.expr("max(value) AS max_value"),
        F.expr(f"min(struct(value AS v, {k} AS k)).k AS min_key"),
        F.expr("min(value) AS min_value"),
        F.expr("avg(value) AS mean_value"),
    )


# --- availability ------------------------------------------------------------


def test_counts(
    obs: DataFrame,
    members: DataFrame,
    subject: str = "subject_id",
    encounter: str = "hadm_id",
    feature: str = "feature",
) -> DataFrame:
    """(cohort, subject, feature, n): observations of cohort members during their
    cohort encounters."""
    keys = members.select("cohort", subject, encounter).distinct()
    return (
        obs.select(subject, encounter, feature)
        .join(keys, [subject, encounter])
        .groupBy("cohort", subject, feature)
        .agg(F.expr("count(1) AS n"))
    )


def availability(
    counts: DataFrame, subjects: DataFrame, subject: str = "subject_id"
) -> DataFrame:
    """Per cohort: subjects, subjects with tests and their percentage, tests, mean
    and median tests per subject with tests. ``subjects`` is (cohort, subjects);
    cohorts without any test keep a row of zeros."""
    per_subject = stage(counts.groupBy("cohort", subject).agg(F.expr("sum(n) AS n")))
    totals = per_subject.groupBy("cohort").agg(
        F.expr("count(1) AS with_tests"), F.expr("sum(n) AS tests")
    )
    middle = quantiles(per_subject, "n", {"median_tests": 0.5}, ["cohort"]).drop("n")
    return (
        subjects.select("cohort", "subjects")
        .join(totals.join(middle, "cohort", "left"), "cohort", "left")
        .na.fill(0)
        .selectExpr(
            "cohort",
            "subjects",
            "with_tests",
            f"{_PCT.format(a='with_tests', b='subjects')} AS pct_with_tests",
            "tests",
            "CASE WHEN with_tests > 0 THEN CAST(tests AS DOUBLE) / with_tests ELSE 0D END AS mean_tests",
            "CAST(median_tests AS DOUBLE) AS median_tests",
        )
    )


def missingness(
    counts: DataFrame,
    cohorts: Sequence[str],
    features: Sequence[str],
    subject: str = "subject_id",
) -> DataFrame:
    """Per cohort and feature: subjects having it, percentage of the cohort's
    subjects with any test, missing percentage, measurements. Every pair has a row."""
    by_pair = counts.groupBy("cohort", "feature").agg(
        F.expr("count(1) AS with_feature"), F.expr("sum(n) AS measurements")
    )
    by_cohort = counts.groupBy("cohort").agg(F.expr(f"count(DISTINCT {q(subject)}) AS with_tests"))
    grid = local_table(
        counts.sparkSession,
        [(c, f) for c in cohorts for f in features],
        "cohort string, feature string",
    )
    return (
        grid.join(by_pair, ["cohort", "feature"], "left")
        .join(by_cohort, "cohort", "left")
        .na.fill(0)
        .selectExpr(
            "cohort",
            "feature",
            "with_feature",
            f"{_PCT.format(a='with_feature', b='with_tests')} AS pct_with",
            f"100D - {_PCT.format(a='with_feature', b='with_tests')} AS pct_missing",
            "measurements",
        )
    )


def missingness_pivot(
    missing: DataFrame, features: Sequence[str], value: str = "pct_missing"
) -> DataFrame:
    """One row per cohort, features as columns in the given order."""
    return missing.groupBy("cohort").agg(
        *[
            F.expr(f"max(CASE WHEN feature = {text(f)} THEN {q(value)} END) AS {q(f)}")
            for f in features
        ]
    )


def coverage_assessment(available: DataFrame) -> DataFrame:
    """Low-coverage flag (under 80 %) and data sufficiency per cohort."""
    return available.selectExpr(
        "cohort",
        "with_tests",
        "pct_with_tests",
        f"pct_with_tests < {LOW_COVERAGE} AS low_coverage",
        f"CASE WHEN with_tests >= {SUFFICIENT[0]} AND pct_with_tests >= {SUFFICIENT[1]} THEN 'sufficient'"
        f" WHEN with_tests >= {MARGINAL_SUBJECTS} THEN 'marginal' ELSE 'insufficient' END AS sufficiency",
    )


def feature_completeness(missing: DataFrame) -> DataFrame:
    """Mean completeness over cohorts per feature, with handling advice."""
    return (
        missing.groupBy("feature")
        .agg(F.expr("avg(pct_with) AS pct_with"), F.expr("avg(pct_missing) AS pct_missing"))
        .selectExpr(
            "feature",
            "pct_with",
            "pct_missing",
            f"pct_missing > {MOSTLY_MISSING} AS mostly_missing",
            f"{_advice('pct_missing', MISSING_ADVICE)} AS strategy",
        )
    )


# --- time since an anchor ----------------------------------------------------


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between each group's minimum and maximum: ``bin`` 1..bins,
    its lower and upper edge and ``n``; empty bins have no row. A constant group
    falls into bin 1."""
    by = list(by)
    rows = df.where(_known(value)).selectExpr(*qs(by), f"CAST({q(value)} AS DOUBLE) AS __v")
    spans, _ = settle(
        rows.groupBy(*by).agg(F.expr("min(__v) AS __lo"), F.expr("max(__v) AS __hi"))
    )
    if by:
        placed = null_safe(rows, spans, by)
    else:
        span = spans.first()
        placed = rows.withColumns(
            {c: F.lit(span[c] if span else None).cast("double") for c in ("__lo", "__hi")}
        )
    slot = (
        f"CASE WHEN __hi > __lo THEN least(CAST(floor((__v - __lo) / (__hi - __lo) * {bins}) AS INT) + 1,"
        f" {bins}) ELSE 1 END AS bin"
    )
    return (
        placed.selectExpr(*qs(by), "__lo", "__hi", slot)
        .groupBy(*by, "__lo", "__hi", "bin")
        .agg(F.expr("count(1) AS n"))
        .selectExpr(
            *qs(by),
            "bin",
            f"__lo + (__hi - __lo) * (bin - 1) / {bins} AS low",
            f"__lo + (__hi - __lo) * bin / {bins} AS high",
            "n",
        )
    )


def timeline(
    obs: DataFrame,
    anchors: DataFrame,
    members: DataFrame,
    subject: str = "subject_id",
    encounter: str = "hadm_id",
    time: str = "charttime",
    anchor_time: str = "admittime",
    band: tuple[float, float] = (-24.0, 168.0),
) -> DataFrame:
    """(cohort, hours) of members' observations inside the band around the anchor;
    input of ``histogram`` and ``describe``."""
    timed = add_hours(obs, anchors, encounter, time, anchor_time).where(
        f"hours BETWEEN {float(band[0])!r}D AND {float(band[1])!r}D"
    )
    people = members.select("cohort", subject).distinct()
    return timed.select(subject, "hours").join(people, subject).select("cohort", "hours")


# --- values ------------------------------------------------------------------


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, from two scans.

    Without groups an empty table has one row of nulls and the count 0.
    """
    by, v = list(by), q(value)
    out = quantiles(
        df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by,
        measures={
            "mean": f"avg({v})",
            "std": f"stddev_samp({v})",
            "min": f"CAST(min({v}) AS DOUBLE)",
            "max": f"CAST(max({v}) AS DOUBLE)",
        },
    )
    shown = [f"{c} AS {c}" for c in ("mean", "std", "min", "max", "q1", "median", "q3")]
    if by:
        return out.selectExpr(*qs(by), "n", *shown)
    # the quantiles are grouped by nothing, so even no rows give one row
    return out.selectExpr("coalesce(n, 0) AS n", *shown)


def range_check(
    df: DataFrame, ref_ranges: DataFrame, value: str, feature: str = "feature"
) -> DataFrame:
    """Observed minimum, maximum, mean, exact median and the shares below and above
    the reference range, per feature, from two scans."""
    named = ref_ranges.selectExpr(f"feature AS {q(feature)}", "low AS ref_low", "high AS ref_high")
    v = q(value)
    keys = [feature, "ref_low", "ref_high"]
    out = quantiles(
        df.select(feature, value).join(named, feature, "left"), value, {"median": 0.5}, keys,
        measures={
            "observed_min": f"min({v})",
            "observed_max": f"max({v})",
            "mean": f"avg({v})",
            "pct_below": f"100D * count_if({v} < ref_low) / count(1)",
            "pct_above": f"100D * count_if({v} > ref_high) / count(1)",
        },
    )
    return out.selectExpr(
        *qs(keys), "n", "observed_min", "observed_max", "mean", "pct_below", "pct_above", "median"
    )


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, pct, rows) for all columns from one pass; NaN is a null."""
    names = list(columns or df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def missing(c: str) -> str:
        nan = f" OR isnan({q(c)})" if kinds[c] in ("double", "float") else ""
        return f"count_if({q(c)} IS NULL{nan}) AS `n{names.index(c)}`"

    counted = df.selectExpr("count(1) AS rows", *[missing(c) for c in names])
    pairs = ", ".join(f"struct({text(c)} AS column, n{i} AS nulls)" for i, c in enumerate(names))
    return counted.selectExpr("rows", f"inline(array({pairs}))").selectExpr(
        "column", "nulls", f"{_PCT.format(a='nulls', b='rows')} AS pct", "rows"
    )


def outliers(
    df: DataFrame,
    value: str,
    feature: str = "feature",
    sigmas: float = 3.0,
    iqr_factor: float = 1.5,
) -> DataFrame:
    """Per feature: n, mean, median, sample deviation, and count and percentage of
    values beyond ``sigmas`` deviations and beyond ``iqr_factor`` quartile distances.

    The bounds of each feature come from the two scans of ``describe``; a third one only counts.
    """
    stats, _ = settle(describe(df.select(feature, value), value, [feature]))
    s, k = f"{float(sigmas)!r}D", f"{float(iqr_factor)!r}D"
    limits = stats.selectExpr(
        q(feature),
        "mean", "median", "std",
        f"mean - {s} * std AS __s0", f"mean + {s} * std AS __s1",
        f"q1 - {k} * (q3 - q1) AS __i0", f"q3 + {k} * (q3 - q1) AS __i1",
    )
    v = q(value)
    joined = null_safe(df.select(feature, value).where(_known(value)), limits, [feature])
    return (
        joined.groupBy(feature, "mean", "median", "std")
        .agg(
            F.expr("count(1) AS n"),
            F.expr(f"count_if({v} < __s0 OR {v} > __s1) AS sigma_outliers"),
            F.expr(f"count_if({v} < __i0 OR {v} > __i1) AS iqr_outliers"),
        )
        .selectExpr(
            q(feature), "n", "mean", "median", "std",
            "sigma_outliers", "100D * sigma_outliers / n AS sigma_pct",
            "iqr_outliers", "100D * iqr_outliers / n AS iqr_pct",
        )
    )


def top(report: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``column``."""
    return report.orderBy(F.col(column).desc(), F.col(tie).asc()).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.expr("count(1) AS n"))


def code_audit(
    facts: DataFrame,
    prefixes: Sequence[str],
    code: str = "icd_code",
    system: str = "icd_version",
) -> DataFrame:
    """How codes are written: facts per system, facts per three-character prefix,
    and facts matched by each given prefix as written and without its dots. One row
    per (kind, item)."""
    c = q(code)
    checks = [
        (kind, p, needle)
        for p in prefixes
        for kind, needle in (("as_written", p), ("without_dots", p.replace(".", "")))
    ]
    matched = ", ".join(
        f"struct({text(kind)} AS kind, CASE WHEN startswith({c}, {text(needle)}) THEN {text(p)} END AS item)"
        for kind, p, needle in checks
    )
    pairs = ", ".join(
        [
            f"struct('system' AS kind, CAST({q(system)} AS STRING) AS item)",
            f"struct('prefix' AS kind, substr({c}, 1, 3) AS item)",
        ]
        + ([matched] if matched else [])
    )
    return (
        facts.selectExpr(f"inline(array({pairs}))")
        .where("item IS NOT NULL")
        .groupBy("kind", "item")
        .agg(F.expr("count(1) AS n"))
    )


def group_difference(
    df: DataFrame, columns: Sequence[str], label: str = "label"
) -> DataFrame:
    """Per feature, cohort (label 1) against control (label 0): sizes, means, sample
    deviations, Welch's t, its degrees of freedom and two-sided p value. Without two rows of
    each class, or without any spread, the last three are null."""
    long = unpivot(df, columns, [label]).where("value IS NOT NULL AND NOT isnan(value)")
    y = q(label)
    stats = long.groupBy("feature").agg(
        *[
            F.expr(f"{fn}(CASE WHEN {y} = {g} THEN value END) AS {name}{g}")
            for g in (1, 0)
            for fn, name in (("count", "n"), ("avg", "mean"), ("stddev_samp", "std"))
        ]
    )
    e1, e0 = "try_divide(std1 * std1, n1)", "try_divide(std0 * std0, n0)"
    return stats.selectExpr("*", f"{e1} AS e1", f"{e0} AS e0").selectExpr(
        *qs(stats.columns),
        "try_divide(mean1 - mean0, sqrt(e1 + e0)) AS t",
        "try_divide(power(e1 + e0, 2),"
        " try_divide(power(e1, 2), n1 - 1) + try_divide(power(e0, 2), n0 - 1)) AS dof",
    ).selectExpr("*", f"{t_two_sided('t', 'dof')} AS p")


def report_where(report: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows of a report with every named column in [low, high)."""
    conditions = [
        f"{q(c)} {sign} {float(v)!r}D"
        for c, (low, high) in bounds.items()
        for sign, v in ((">=", low), ("<", high))
        if v is not None
    ]
    return report.where(" AND ".join(conditions)) if conditions else report
