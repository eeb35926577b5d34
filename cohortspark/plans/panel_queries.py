"""Queries over the event panel: look back, pivot, impute, scale, flags."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.times import as_timestamp
from ..operators.confusion import flag_metrics
from ..operators.panel import (
    STATS,
    clean_observations,
    derived_features,
    feature_frame,
    item_stats,
    lookback,
    map_items,
    min_tests,
    missing_flags,
    stat_column,
)
from ..operators.prepare import Imputer, Scaler, remove_outliers
from ..operators.profile import (
    describe,
    group_difference,
    histogram,
    null_audit,
    outliers,
    range_check,
    top,
    value_counts,
)
from ..operators.selection import f_scores, mutual_information
from ..operators.thresholds import QuantileFlags, RangeFlags
from ..session import stage
from ..sources.bucketed import save_bucketed
from ..sources.tables import only_items
from . import bindings as b
from .experiment import evaluate_flags
from .registry import query, r

IDS = ("user_id", "label")
_AGG = {
    "mean": "avg(value) FILTER (WHERE event_type = '{e}')",
    "min": "min(value) FILTER (WHERE event_type = '{e}')",
    "max": "max(value) FILTER (WHERE event_type = '{e}')",
    "std": "stddev_samp(value) FILTER (WHERE event_type = '{e}')",
    "count": "nullif(count(value) FILTER (WHERE event_type = '{e}'), 0)",
}
COLUMNS = [stat_column(e, s) for s in STATS for e in b.EVENT_TYPES]


def panel_sql(days: int | None) -> str:
    cut = "" if days is None else f"WHERE e.ts >= m.mx - INTERVAL {days} DAY"
    cells = ", ".join(
        f"{_AGG[s].format(e=e)} AS {stat_column(e, s)}" for s in STATS for e in b.EVENT_TYPES
    )
    return (
        "recent AS (SELECT e.* FROM events e JOIN (SELECT user_id, max(ts) AS mx FROM events"
        f" GROUP BY user_id) m ON e.user_id = m.user_id {cut}),"
        f" panel AS (SELECT user_id, {cells} FROM recent GROUP BY user_id)"
    )


def _shown(columns, source, doubles=True) -> str:
    cells = ", ".join(
        c if c.endswith("_count") and not doubles else r(c, c) for c in columns
    )
    return f"SELECT user_id, {cells} FROM {source}"


@query("panel_lookback_pivot", f"WITH {panel_sql(2)} {_shown(COLUMNS, 'panel', False)}")
def panel_lookback_pivot(spark, sf):
    return b.panel(spark, sf, 2)


@query("bucketed_lookback", f"WITH {panel_sql(2)} {_shown(COLUMNS, 'panel', False)}")
def bucketed_lookback(spark, sf):
    """The look-back panel from events that are stored by user."""
    stored = save_bucketed(b.events(spark, sf), f"events_{uuid.uuid4().hex}", ["user_id"])
    items = b.event_items(spark)
    return stored.apply(
        lambda part, colocated: feature_frame(part, items, b.EVENT_TYPES, 2, b.PANEL, colocated=colocated)
    )


@query("panel_all_time", f"WITH {panel_sql(None)} {_shown(COLUMNS, 'panel', False)}")
def panel_all_time(spark, sf):
    return b.panel(spark, sf, None)


@query(
    "item_stats_long",
    f"WITH {panel_sql(1)} SELECT user_id, event_type AS feature, {r('avg(value)', 'mean')},"
    f" {r('stddev_samp(value)', 'std')}, count(value) AS count, {r('sum(value)', 'sum')}"
    " FROM recent GROUP BY user_id, event_type",
)
def item_stats_long(spark, sf):
    named = map_items(b.events(spark, sf), b.event_items(spark), b.PANEL)
    recent = lookback(named, 1, b.PANEL)
    return item_stats(recent, ["user_id", "feature"], "value", ("mean", "std", "count", "sum"))


# --- imputation and scaling --------------------------------------------------


def _filled(fn: str) -> str:
    fills = ", ".join(f"{fn}({c}) AS {c}" for c in COLUMNS)
    cells = ", ".join(f"coalesce(CAST(p.{c} AS DOUBLE), f.{c}) AS {c}" for c in COLUMNS)
    return (
        f"fill AS (SELECT {fills} FROM panel),"
        f" filled AS (SELECT p.user_id, {cells} FROM panel p CROSS JOIN fill f)"
    )


def _impute(spark, sf, strategy):
    frame = stage(b.panel(spark, sf, 2))
    return Imputer(strategy, IDS).fit_transform(frame)


@query(
    "panel_impute_median",
    f"WITH {panel_sql(2)}, {_filled('median')} {_shown(COLUMNS, 'filled')}",
)
def panel_impute_median(spark, sf):
    return _impute(spark, sf, "median")


@query(
    "panel_impute_mean", f"WITH {panel_sql(2)}, {_filled('avg')} {_shown(COLUMNS, 'filled')}"
)
def panel_impute_mean(spark, sf):
    return _impute(spark, sf, "mean")


@query(
    "panel_impute_zero",
    f"WITH {panel_sql(2)} SELECT user_id,"
    f" {', '.join(r(f'coalesce({c}, 0)', c) for c in COLUMNS)} FROM panel",
)
def panel_impute_zero(spark, sf):
    return Imputer("zero", IDS).transform(b.panel(spark, sf, 2))


@query(
    "panel_impute_drop",
    f"WITH {panel_sql(7)} {_shown(COLUMNS, 'panel', False)}"
    f" WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLUMNS)}",
)
def panel_impute_drop(spark, sf):
    return Imputer("drop", IDS).transform(b.panel(spark, sf, 7))


def _scaled(centre: str, width: str) -> str:
    params = ", ".join(
        f"{centre.format(c=c)} AS {c}_a, {width.format(c=c)} AS {c}_b" for c in COLUMNS
    )
    cells = ", ".join(
        r(f"(x.{c} - s.{c}_a) / CASE WHEN s.{c}_b <= 1e-12 THEN 1 ELSE s.{c}_b END", c)
        for c in COLUMNS
    )
    return (
        f"WITH {panel_sql(2)}, {_filled('median')}, s AS (SELECT {params} FROM filled)"
        f" SELECT x.user_id, {cells} FROM filled x CROSS JOIN s"
    )


@query("panel_scale_standard", _scaled("avg({c})", "stddev_pop({c})"))
def panel_scale_standard(spark, sf):
    filled = stage(_impute(spark, sf, "median"))
    return Scaler("standard", IDS).fit_transform(filled)


@query("panel_scale_minmax", _scaled("min({c})", "max({c}) - min({c})"))
def panel_scale_minmax(spark, sf):
    filled = stage(_impute(spark, sf, "median"))
    return Scaler("minmax", IDS).fit_transform(filled)


_COUNTS = [f"{e}_count" for e in b.EVENT_TYPES]


@query(
    "min_tests_filter",
    f"WITH {panel_sql(2)} {_shown(COLUMNS, 'panel', False)}"
    f" WHERE {' AND '.join(f'({c} IS NULL OR {c} >= 2)' for c in _COUNTS)}",
)
def min_tests_filter(spark, sf):
    return min_tests(b.panel(spark, sf, 2), 2)


@query(
    "min_tests_any",
    f"WITH {panel_sql(2)} {_shown(COLUMNS, 'panel', False)}"
    f" WHERE {' OR '.join(f'{c} >= 3' for c in _COUNTS)}",
)
def min_tests_any(spark, sf):
    return min_tests(b.panel(spark, sf, 2), 3, "any")


@query(
    "derived_and_missing",
    f"WITH {panel_sql(2)} SELECT user_id, {r('click / nullif(view, 0)', 'click_view')},"
    f" {r('purchase / nullif(signup, 0)', 'purchase_signup')},"
    " CAST(click IS NULL AS INT) AS click_missing, CAST(error IS NULL AS INT) AS error_missing FROM panel",
)
def derived_and_missing(spark, sf):
    wide = derived_features(
        b.panel(spark, sf, 2),
        {"click_view": ("click", "view"), "purchase_signup": ("purchase", "signup")},
    )
    return missing_flags(wide, ["click", "error"]).select(
        "user_id", "click_view", "purchase_signup", "click_missing", "error_missing"
    )


@query(
    "clean_observations",
    "SELECT event_id, event_type, " + r("value", "value") + " FROM events WHERE value > 0 AND"
    " CASE event_type WHEN 'click' THEN value BETWEEN 5 AND 90 WHEN 'view' THEN value BETWEEN 1 AND 60"
    " ELSE true END",
)
def clean_obs(spark, sf):
    rows = b.events(spark, sf).select("event_id", "event_type", "value")
    return clean_observations(rows, "value", {"click": (5, 90), "view": (1, 60)}, "event_type")


@query(
    "item_filtered_scan",
    "SELECT event_id, event_type, " + r("value", "value")
    + " FROM events WHERE event_type IN ('click', 'purchase')",
)
def item_filtered_scan(spark, sf):
    return only_items(b.events(spark, sf), ["click", "purchase"], "event_type").select(
        "event_id", "event_type", "value"
    )


# --- flags -------------------------------------------------------------------


def _flag_sql(limits: str | None, source: str) -> str:
    cells = []
    for e in b.EVENT_TYPES:
        f = b.CONFIG.features[e]
        lo = f"{f['low']}" if limits is None else f"{limits}.{e}_lo"
        hi = f"{f['high']}" if limits is None else f"{limits}.{e}_hi"
        cells += [
            f"CAST({e} < {lo} AS INT) AS {e}_low",
            f"CAST({e} > {hi} AS INT) AS {e}_high",
            f"CAST({e} < {lo} OR {e} > {hi} AS INT) AS {e}_abnormal",
        ]
    return f"SELECT user_id, {', '.join(cells)} FROM {source}"


@query("range_flags", f"WITH {panel_sql(2)} {_flag_sql(None, 'panel')}")
def range_flags(spark, sf):
    frame = b.panel(spark, sf, 2)
    return RangeFlags(b.ranges()).fit(frame, b.EVENT_TYPES).transform(frame, ["user_id"])


_PLIMITS = ", ".join(
    f"quantile_cont({e}, 0.1) AS {e}_lo, quantile_cont({e}, 0.9) AS {e}_hi" for e in b.EVENT_TYPES
)


@query(
    "percentile_flags",
    f"WITH {panel_sql(7)}, l AS (SELECT {_PLIMITS} FROM panel) {_flag_sql('l', 'panel CROSS JOIN l')}",
)
def percentile_flags(spark, sf):
    frame = stage(b.panel(spark, sf, 7).select("user_id", *b.EVENT_TYPES))
    return QuantileFlags().fit(frame, b.EVENT_TYPES).transform(frame, ["user_id"])


USER_SQL = (
    "users AS (SELECT p.user_id, coalesce(click, 0) AS click, coalesce(purchase, 0) AS purchase,"
    " coalesce(signup, 0) AS signup, coalesce(view, 0) AS view,"
    " CAST(h.user_id IS NOT NULL AS INT) AS label"
    " FROM panel p LEFT JOIN (SELECT DISTINCT e.user_id FROM events e JOIN (SELECT user_id, max(ts) AS mx"
    " FROM events GROUP BY user_id) m ON e.user_id = m.user_id"
    " WHERE e.ts >= m.mx - INTERVAL 2 DAY AND e.event_type = 'error') h ON p.user_id = h.user_id)"
)
USER_FEATURES = ["click", "purchase", "signup", "view"]


@query(
    "user_frame",
    f"WITH {panel_sql(None)}, {USER_SQL} SELECT user_id, label,"
    f" {', '.join(r(f, f) for f in USER_FEATURES)} FROM users",
)
def user_frame(spark, sf):
    return b.user_frame(spark, sf)[0]


METRICS_SQL = {
    "accuracy": "(tp + tn) / nullif(tp + tn + fp + fn, 0)",
    "precision": "tp / nullif(tp + fp, 0)",
    "recall": "tp / nullif(tp + fn, 0)",
    "sensitivity": "tp / nullif(tp + fn, 0)",
    "specificity": "tn / nullif(tn + fp, 0)",
    "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
}
AUC_SQL = (
    "CASE WHEN tp + fp = 0 OR tn + fn = 0 OR tp + fn = 0 OR tn + fp = 0 THEN 0.5"
    " ELSE (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 END"
)


def metrics_select(by: str = "", auc: bool = True, rounding: bool = True) -> str:
    cells = {n: f"coalesce({e}, 0)" for n, e in METRICS_SQL.items()}
    if auc:
        cells["auc"] = AUC_SQL
    cells = [r(e, n) if rounding else f"{e} AS {n}" for n, e in cells.items()]
    return f"{by}{', ' if by else ''}tn, fp, fn, tp, {', '.join(cells)}"


def confusion_sql(source: str, p: str = "prediction", by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {by}{', ' if by else ''}count(*) FILTER (WHERE label = 0 AND {p} = 0) AS tn,"
        f" count(*) FILTER (WHERE label = 0 AND {p} = 1) AS fp,"
        f" count(*) FILTER (WHERE label = 1 AND {p} = 0) AS fn,"
        f" count(*) FILTER (WHERE label = 1 AND {p} = 1) AS tp FROM {source}{group}"
    )


def _user_flags_sql() -> tuple[str, list[str]]:
    cells, names = [], []
    for e in USER_FEATURES:
        lo, hi = b.CONFIG.features[e]["low"], b.CONFIG.features[e]["high"]
        for n, c in (("low", f"{e} < {lo}"), ("high", f"{e} > {hi}"), ("abnormal", f"({e} < {lo} OR {e} > {hi})")):
            cells.append(f"CAST({c} AS INT) AS {e}_{n}")
            names.append(f"{e}_{n}")
    return f"flags AS (SELECT label, {', '.join(cells)} FROM users)", names


_FLAGS, _FLAG_NAMES = _user_flags_sql()
_LONG_FLAGS = " UNION ALL ".join(
    f"SELECT '{n}' AS flag, label, {n} AS prediction FROM flags" for n in _FLAG_NAMES
)


@query(
    "flag_metrics",
    f"WITH {panel_sql(None)}, {USER_SQL}, {_FLAGS}, long AS ({_LONG_FLAGS}),"
    f" c AS ({confusion_sql('long', by='flag')}) SELECT {metrics_select('flag')} FROM c",
)
def flag_metrics_query(spark, sf):
    frame, names = b.user_frame(spark, sf)
    flags = RangeFlags(b.ranges()).fit(frame, names)
    return flag_metrics(flags.transform(frame, ["label"]), flags.flag_names())


@query(
    "flag_score_metrics",
    f"WITH {panel_sql(None)}, {USER_SQL}, {_FLAGS},"
    f" s AS (SELECT label, ({' + '.join(_FLAG_NAMES)}) / {len(_FLAG_NAMES)}.0 AS score FROM flags),"
    " sp AS (SELECT label, CAST(score AS DOUBLE) AS score, CAST(score >= 0.5 AS INT) AS prediction FROM s),"
    f" c AS ({confusion_sql('sp')}),"
    " g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sp GROUP BY score),"
    " roc AS (SELECT score, pos, neg, sum(pos) OVER w AS tp1, sum(neg) OVER w AS fp1,"
    " sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)),"
    " a AS (SELECT sum(neg * (tp1 - pos + pos / 2.0)) / max(p * n) AS auc FROM roc),"
    " y AS (SELECT score AS t, tp1 / p - fp1 / n AS j FROM roc ORDER BY j DESC, t DESC LIMIT 1)"
    f" SELECT 'ranges' AS method, {metrics_select(auc=False)}, {r('auc', 'auc')},"
    f" {r('CASE WHEN j > 0 THEN t END', 'optimal_threshold')}, {r('greatest(j, 0)', 'youden_index')}"
    " FROM c, a, y",
)
def flag_score_metrics(spark, sf):
    frame, names = b.user_frame(spark, sf)
    frame = stage(frame)
    return evaluate_flags(RangeFlags(b.ranges()), frame, frame, names, name="ranges")


# --- values ------------------------------------------------------------------


_DESCRIBE = (
    f"count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')},"
    f" {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('quantile_cont(value, 0.25)', 'q1')},"
    f" {r('median(value)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')}"
)


@query("describe_by_item", f"SELECT event_type, {_DESCRIBE} FROM events GROUP BY event_type")
def describe_by_item(spark, sf):
    return describe(b.events(spark, sf).select("event_type", "value"), "value", ["event_type"])


@query("describe_all", f"SELECT {_DESCRIBE.replace('value', 'l_extendedprice')} FROM lineitem")
def describe_all(spark, sf):
    return describe(b.table(spark, sf, "lineitem"), "l_extendedprice")


_RANGES = ", ".join(
    f"('{n}', {f['low']}, {f['high']})" for n, f in b.CONFIG.features.items()
)


@query(
    "range_check",
    f"WITH ranges(event_type, lo, hi) AS (VALUES {_RANGES}) SELECT event_type,"
    f" {r('lo', 'ref_low')}, {r('hi', 'ref_high')}, count(*) AS n, {r('min(value)', 'observed_min')},"
    f" {r('max(value)', 'observed_max')}, {r('avg(value)', 'mean')},"
    f" {r('100.0 * count(*) FILTER (WHERE value < lo) / count(*)', 'pct_below')},"
    f" {r('100.0 * count(*) FILTER (WHERE value > hi) / count(*)', 'pct_above')},"
    f" {r('median(value)', 'median')} FROM events JOIN ranges USING (event_type) GROUP BY event_type, lo, hi",
)
def range_check_query(spark, sf):
    rows = b.events(spark, sf).select("event_type", "value")
    return range_check(rows, b.CONFIG.ref_ranges(spark), "value", "event_type")


def _audit(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls,"
        f" {r(f'100.0 * (count(*) - count({c})) / count(*)', 'pct')}, count(*) AS rows FROM {table}"
        for c in columns
    )


@query("null_audit", f"WITH {panel_sql(1)} {_audit('panel', COLUMNS)}")
def null_audit_query(spark, sf):
    return null_audit(b.panel(spark, sf, 1), COLUMNS)


_OUTLIERS = (
    "WITH s AS (SELECT event_type, avg(value) AS mean, median(value) AS med, stddev_samp(value) AS std,"
    " quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),"
    " o AS (SELECT event_type, count(*) AS n, any_value(mean) AS mean, any_value(med) AS med, any_value(std) AS std,"
    " count(*) FILTER (WHERE value < mean - 3 * std OR value > mean + 3 * std) AS so,"
    " count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS io"
    " FROM events JOIN s USING (event_type) GROUP BY event_type)"
    f" SELECT event_type, n, {r('mean', 'mean')}, {r('med', 'median')}, {r('std', 'std')}, so AS sigma_outliers,"
    f" {r('100.0 * so / n', 'sigma_pct')}, io AS iqr_outliers, {r('100.0 * io / n', 'iqr_pct')} FROM o"
)


@query("outliers", _OUTLIERS)
def outliers_query(spark, sf):
    return outliers(b.events(spark, sf), "value", "event_type")


@query("top_outliers", f"{_OUTLIERS} ORDER BY sigma_pct DESC, event_type LIMIT 3")
def top_outliers(spark, sf):
    return top(outliers(b.events(spark, sf), "value", "event_type"), "sigma_pct", 3, "event_type")


def _drop_sql(lo: str, hi: str, cols: list[str]) -> str:
    limits = ", ".join(f"{lo.format(c=c)} AS {c}_lo, {hi.format(c=c)} AS {c}_hi" for c in cols)
    keep = " AND ".join(f"{c} BETWEEN {c}_lo AND {c}_hi" for c in cols)
    return f"WITH l AS (SELECT {limits} FROM lineitem) SELECT count(*) AS n, {', '.join(r(f'avg({c})', f'avg_{c}') for c in cols)} FROM lineitem, l WHERE {keep}"


_VALUES = ["l_quantity", "l_extendedprice"]


@query(
    "drop_outliers_iqr",
    _drop_sql(
        "quantile_cont({c}, 0.25) - 0.4 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
        "quantile_cont({c}, 0.75) + 0.4 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
        _VALUES,
    ),
)
def drop_outliers_iqr(spark, sf):
    kept = remove_outliers(b.table(spark, sf, "lineitem").select(*_VALUES), _VALUES, "iqr", 0.4)
    return kept.selectExpr("count(1) AS n", *[f"avg({c}) AS avg_{c}" for c in _VALUES])


@query(
    "drop_outliers_zscore",
    _drop_sql("avg({c}) - 1.5 * stddev_samp({c})", "avg({c}) + 1.5 * stddev_samp({c})", _VALUES),
)
def drop_outliers_zscore(spark, sf):
    kept = remove_outliers(b.table(spark, sf, "lineitem").select(*_VALUES), _VALUES, "zscore", 1.5)
    return kept.selectExpr("count(1) AS n", *[f"avg({c}) AS avg_{c}" for c in _VALUES])


def _hist_sql(table: str, value: str, bins: int, by: str) -> str:
    lo, hi = f"lo + (hi - lo) * (bin - 1) / {bins}", f"lo + (hi - lo) * bin / {bins}"
    return (
        f"WITH s AS (SELECT {by}, min({value}) AS lo, max({value}) AS hi FROM {table} GROUP BY {by}),"
        f" p AS (SELECT {by}, lo, hi, CASE WHEN hi > lo THEN least(CAST(floor(({value} - lo) / (hi - lo) * {bins}) AS INT) + 1, {bins})"
        f" ELSE 1 END AS bin FROM {table} JOIN s USING ({by}))"
        f" SELECT {by}, CAST(bin AS INT) AS bin, {r(lo, 'low')}, {r(hi, 'high')}, count(*) AS n FROM p GROUP BY {by}, lo, hi, bin"
    )


@query("value_histogram", _hist_sql("events", "value", 50, "event_type"))
def value_histogram(spark, sf):
    return histogram(b.events(spark, sf), "value", 50, ["event_type"])


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts_query(spark, sf):
    return value_counts(b.events(spark, sf), "event_type")


# Two-sided p of t by the power series of the incomplete beta, summed from its other end.
STUDENT_SERIES = (
    "CASE WHEN t = 0 THEN 1 ELSE 1 - 2 * sqrt(t * t / (dof + t * t)) * exp(-dof / 2 * ln(1 + t * t / dof)"
    " + lgamma(dof / 2 + 0.5) - lgamma(dof / 2)) / sqrt(pi()) * list_sum(list_transform("
    "range(0, CAST(300 + 40 * t * t AS BIGINT)), lambda n: exp(lgamma(dof / 2 + 0.5 + n) - lgamma(dof / 2 + 0.5)"
    " - lgamma(1.5 + n) + lgamma(1.5) + n * ln(t * t / (dof + t * t))))) END"
)


@query(
    "group_difference",
    f"WITH {panel_sql(None)}, {USER_SQL}, long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, label, {f} AS value FROM users" for f in USER_FEATURES)
    + "), s AS (SELECT feature, "
    + ", ".join(
        f"{fn}(value) FILTER (WHERE label = {g}) AS {n}{g}"
        for g in (1, 0)
        for fn, n in (("count", "n"), ("avg", "mean"), ("stddev_samp", "std"))
    )
    + " FROM long GROUP BY feature) SELECT feature, n1, n0,"
    f" {r('mean1', 'mean1')}, {r('mean0', 'mean0')}, {r('std1', 'std1')}, {r('std0', 'std0')},"
    f" {r('t', 't')}, {r('dof', 'dof')},"
    # the power series of the incomplete beta from the other end
    f" {r('p', 'p')} FROM (SELECT *, {STUDENT_SERIES} AS p"
    " FROM (SELECT *, (mean1 - mean0) / sqrt(std1 * std1 / n1 + std0 * std0 / n0) AS t,"
    " pow(std1 * std1 / n1 + std0 * std0 / n0, 2) / (pow(std1 * std1 / n1, 2) / (n1 - 1) + pow(std0 * std0 / n0, 2) / (n0 - 1)) AS dof FROM s))",
)
def group_difference_query(spark, sf):
    frame, names = b.user_frame(spark, sf)
    return group_difference(frame, names)


@query(
    "anova_scores",
    f"WITH {panel_sql(None)}, {USER_SQL}, long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, label, {f} AS value FROM users" for f in USER_FEATURES)
    + "), g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY feature, label),"
    " t AS (SELECT feature, avg(value) AS gm FROM long GROUP BY feature)"
    f" SELECT feature, {r('sum(n * pow(m - gm, 2)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*)))', 'score')}"
    " FROM g JOIN t USING (feature) GROUP BY feature",
)
def anova_scores(spark, sf):
    frame, names = b.user_frame(spark, sf)
    return f_scores(frame, names)


def _mi_sql(bins: int) -> str:
    cuts = ", ".join(
        f"quantile_cont({f}, {i / bins!r}) AS {f}_{i}" for f in USER_FEATURES for i in range(1, bins)
    )
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, label, "
        + " + ".join(f"CAST({f} > {f}_{i} AS INT)" for i in range(1, bins))
        + " AS bin FROM users, q"
        for f in USER_FEATURES
    )
    return (
        f"WITH {panel_sql(None)}, {USER_SQL}, q AS (SELECT {cuts} FROM users), long AS ({long}),"
        " c AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY feature, bin, label),"
        " m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bin) AS nb,"
        " sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS nt FROM c)"
        f" SELECT feature, {r('sum(n / nt * ln(n * nt / (nb * nl)))', 'score')} FROM m GROUP BY feature"
    )


@query("mutual_information", _mi_sql(10))
def mutual_information_query(spark, sf):
    frame, names = b.user_frame(spark, sf)
    return mutual_information(stage(frame), names, bins=10)


@query(
    "scale_small_values",
    "WITH t AS (SELECT event_id, value * 1e-13 AS tiny FROM events), s AS (SELECT avg(tiny) AS m, stddev_pop(tiny) AS d FROM t)"
    f" SELECT event_id, {r('(tiny - m) / d', 'tiny')} FROM t CROSS JOIN s",
)
def scale_small_values(spark, sf):
    """A column of small numbers is scaled like any other."""
    tiny = b.events(spark, sf).selectExpr("event_id", "value * 1e-13D AS tiny")
    return Scaler("standard", ["event_id"]).fit_transform(tiny)


@query(
    "text_times",
    "SELECT user_id, max(ts) AS latest, " + r("avg(value)", "mean")
    + " FROM events GROUP BY user_id",
)
def text_times(spark, sf):
    """Times stored as text are parsed on use."""
    text = b.events(spark, sf).withColumn("ts", F.col("ts").cast("string"))
    return as_timestamp(text, "ts").groupBy("user_id").agg(F.expr("max(ts) AS latest"), F.expr("avg(value) AS mean"))
