"""Timed observations to a feature frame: map, window, aggregate, pivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import as_timestamp, hours_between, within_hours
from ..session import null_safe, require_columns
from .ranking import q, qs, text

STATS = ("mean", "min", "max", "std", "count")
_STAT_SQL = {
    "mean": "avg({v})",
    "min": "min({v})",
    "max": "max({v})",
    "std": "stddev_samp({v})",
    "count": "count({v})",
    "sum": "sum({v})",
    "var": "var_samp({v})",
}


@dataclass(frozen=True)
class Obs:
    """Column names of an observation table."""

    subject: str = "subject_id"
    item: str = "itemid"
    time: str = "charttime"
    value: str = "valuenum"


def map_items(obs: DataFrame, item_map: DataFrame, cols: Obs = Obs()) -> DataFrame:
    """Add ``feature`` through the (itemid, feature) table; unknown items go away."""
    named = item_map.selectExpr(f"{q(item_map.columns[0])} AS {q(cols.item)}", "feature")
    return obs.join(named, cols.item)


def lookback(
    obs: DataFrame,
    days: int | None,
    cols: Obs = Obs(),
    anchor: DataFrame | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Observations at most ``days`` before the subject's latest one.

    ``anchor`` (subject, anchor_time) replaces the latest observation as the end.
    The latest time is aggregated map-side and joined back. The join's null-safe
    keys keep its partitioning apart from the grouping that follows, so adaptive
    execution may split a subject that holds a large part of the rows; a window over
    the subject could not be split. Rows without a subject are left out.
    ``colocated=True``, for tables bucketed by subject without hot ones, joins on the
    subject itself, so nothing moves.
    """
    if days is None:
        return obs
    require_columns(obs, [cols.time, cols.subject], "observations")
    obs = as_timestamp(obs, cols.time)
    if anchor is None:
        end = obs.groupBy(cols.subject).agg(F.max(cols.time).alias("__end"))
    else:
        require_columns(anchor, [cols.subject, "anchor_time"], "anchor")
        end = as_timestamp(anchor, "anchor_time").selectExpr(
            q(cols.subject), "anchor_time AS __end"
        )
    present = f"{q(cols.subject)} IS NOT NULL"
    sides = obs.where(present), end.where(present)
    joined = sides[0].join(sides[1], cols.subject) if colocated else null_safe(*sides, [cols.subject])
    floor = f"__end - make_dt_interval({int(days)})"
    keep = f"{q(cols.time)} >= {floor}"
    if anchor is not None:
        keep += f" AND {q(cols.time)} <= __end"
    return joined.where(keep).drop("__end")


def item_stats(
    obs: DataFrame, by: Sequence[str], value: str = "valuenum", stats: Sequence[str] = STATS
) -> DataFrame:
    """Mean, min, max, sample deviation and non-null count per group."""
    v = f"nanvl(CAST({q(value)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    unknown = [s for s in stats if s not in _STAT_SQL]
    if unknown:
        raise ValueError(f"unknown statistic(s) {unknown}; known: {sorted(_STAT_SQL)}")
    return obs.groupBy(*by).agg(
        *[F.expr(f"{_STAT_SQL[s].format(v=v)} AS {q(s)}") for s in stats]
    )


def stat_column(feature: str, stat: str) -> str:
    """The mean keeps the bare feature name."""
    return feature if stat == "mean" else f"{feature}_{stat}"


def pivot_stats(
    stats: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    names: Sequence[str] = STATS,
    feature: str = "feature",
) -> DataFrame:
    """Long statistics to one row per id, columns ordered by statistic.

    The features are given, so no job is needed to find them and the result has
    the same columns on any data.
    """
    wide = stats.groupBy(*ids).agg(
        *[
            F.expr(
                f"max(CASE WHEN {q(feature)} = {text(f)} THEN {q(s)} END) AS {q(stat_column(f, s))}"
            )
            for s in names
            for f in features
        ]
    )
    return wide


def feature_frame(
    obs: DataFrame,
    item_map: DataFrame,
    features: Sequence[str],
    lookback_days: int | None = 30,
    cols: Obs = Obs(),
    stats: Sequence[str] = STATS,
    anchor: DataFrame | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Observations to one row per subject: map items, look back, aggregate, pivot."""
    require_columns(obs, [cols.subject, cols.item, cols.value], "observations")
    named = map_items(obs, item_map, cols)
    recent = lookback(named, lookback_days, cols, anchor, colocated)
    long = item_stats(recent, [cols.subject, "feature"], cols.value, stats)
    return pivot_stats(long, features, [cols.subject], stats)


def add_hours(
    obs: DataFrame,
    anchors: DataFrame,
    key: str | Sequence[str],
    time: str,
    anchor_time: str,
    colocated: bool = False,
) -> DataFrame:
    """Left join the anchor time and add ``hours`` since it; an encounter with very
    many rows may be split, and bucketed tables need not move, as in ``lookback``."""
    keys = [key] if isinstance(key, str) else list(key)
    named = anchors.select(*keys, anchor_time).where(
        " AND ".join(f"{q(k)} IS NOT NULL" for k in keys)
    )
    joined = obs.join(named, keys, "left") if colocated else null_safe(obs, named, keys, "left")
    joined = as_timestamp(as_timestamp(joined, time), anchor_time)
    return joined.withColumn("hours", hours_between(joined, anchor_time, time))


def anchored_features(
    obs: DataFrame,
    anchors: DataFrame,
    item_map: DataFrame | None,
    features: Sequence[str],
    encounter: str = "hadm_id",
    anchor_time: str = "admittime",
    hours: tuple[float, float] = (0.0, 24.0),
    cols: Obs = Obs(),
    stats: Sequence[str] = STATS,
    colocated: bool = False,
) -> DataFrame:
    """Statistics of the observations in a band of hours around each encounter's
    anchor, one row per encounter, for all encounters in one job."""
    named = obs if item_map is None else map_items(obs, item_map, cols)
    timed = add_hours(named, anchors, encounter, cols.time, anchor_time, colocated)
    inside = timed.where(within_hours(F.col("hours"), *hours))
    long = item_stats(inside, [encounter, "feature"], cols.value, stats)
    return pivot_stats(long, features, [encounter], stats)


def min_tests(df: DataFrame, n: int, mode: str = "all") -> DataFrame:
    """Rows where each ``*_count`` is null or at least ``n`` (``mode='all'``), or
    where one of them reaches ``n`` (``'any'``). ``n <= 1`` keeps everything."""
    if mode not in ("all", "any"):
        raise ValueError(f"mode must be 'all' or 'any', not {mode!r}")
    counts = [c for c in df.columns if c.endswith("_count")]
    if n <= 1 or not counts:
        return df
    if mode == "all":
        return df.where(" AND ".join(f"({q(c)} IS NULL OR {q(c)} >= {int(n)})" for c in counts))
    return df.where(f"greatest({', '.join(qs(counts))}, 0) >= {int(n)}")


def clean_observations(
    obs: DataFrame,
    value: str = "valuenum",
    plausible: Mapping[str, tuple[float, float]] | None = None,
    feature: str = "feature",
) -> DataFrame:
    """Drop null, NaN and non-positive values, and values outside a feature's
    plausible range where one is given."""
    v = q(value)
    out = obs.where(f"{v} IS NOT NULL AND NOT isnan(CAST({v} AS DOUBLE)) AND {v} > 0")
    if plausible:
        cases = " ".join(
            f"WHEN {text(f)} THEN {v} BETWEEN {float(lo)!r}D AND {float(hi)!r}D"
            for f, (lo, hi) in plausible.items()
        )
        out = out.where(f"CASE {q(feature)} {cases} ELSE true END")
    return out


def derived_features(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ratio columns; a zero or missing denominator gives null."""
    return df.selectExpr(
        "*",
        *[
            f"try_divide(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE)) AS {q(name)}"
            for name, (a, b) in ratios.items()
        ],
    )


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``*_missing`` 0/1 columns."""
    return df.selectExpr(
        "*", *[f"CAST({q(c)} IS NULL AS INT) AS `{c}_missing`" for c in columns]
    )


def time_features(
    obs: DataFrame,
    anchors: DataFrame,
    ref_ranges: DataFrame,
    encounter: str = "hadm_id",
    anchor_time: str = "admittime",
    cols: Obs = Obs(item="feature"),
    baseline_hours: float = 24.0,
    change_hours: float = 168.0,
) -> DataFrame:
    """Per (encounter, feature): first value within ``baseline_hours``, change from
    it to the last value within ``change_hours``, hours to the first value outside
    the reference range, and the extremes after the anchor."""
    timed = add_hours(obs, anchors, encounter, cols.time, anchor_time).where("hours >= 0")
    ranged = timed.join(ref_ranges.select("feature", "low", "high"), "feature", "left")
    v = q(cols.value)
    # the value breaks ties between observations of the same instant
    grouped = ranged.groupBy(encounter, "feature").agg(
        F.expr(
            f"min(CASE WHEN hours <= {float(baseline_hours)!r}D"
            f" THEN struct(hours, {v} AS v) END).v AS baseline"
        ),
        F.expr(
            f"max(CASE WHEN hours <= {float(change_hours)!r}D"
            f" THEN struct(hours, {v} AS v) END).v AS __last"
        ),
        F.expr(f"min(CASE WHEN {v} < low OR {v} > high THEN hours END) AS hours_to_abnormal"),
        F.expr(f"min({v}) AS min_value"),
        F.expr(f"max({v}) AS max_value"),
    )
    return grouped.selectExpr(
        q(encounter), "feature", "baseline", "__last - baseline AS change",
        "hours_to_abnormal", "min_value", "max_value",
    )
