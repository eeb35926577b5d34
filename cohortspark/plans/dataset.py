"""From source tables to a modelling frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.cohort import all_labels, cohort_labels
from ..operators.panel import Obs, feature_frame, min_tests
from ..operators.prepare import Imputer, Scaler
from ..operators.split import Splitter, parts
from ..session import stage
from ..sources.config import Config
from ..sources.tables import Tables


@dataclass(frozen=True)
class Names:
    """Column names of the source tables."""

    subject: str = "subject_id"
    encounter: str = "hadm_id"
    code: str = "icd_code"
    system: str = "icd_version"
    obs: Obs = Obs()


def labelled_frame(
    tables: Tables,
    config: Config,
    cohort: str,
    lookback_days: int | None = 30,
    min_count: int = 1,
    names: Names = Names(),
    normalize_codes: bool = True,
    match_system: bool = True,
) -> DataFrame:
    """Features of every observed subject with the cohort label; one lazy plan."""
    labels = cohort_labels(
        tables.admissions(),
        tables.diagnoses(),
        config.code_rules([cohort]),
        cohort,
        names.subject,
        code=names.code,
        system=names.system,
        normalize=normalize_codes,
        match_system=match_system,
    )
    features = feature_frame(
        tables.lab_results(),
        config.item_map(tables.spark),
        config.feature_names(),
        lookback_days,
        names.obs,
    )
    return min_tests(features, min_count).join(labels, names.subject)


@dataclass(frozen=True)
class Dataset:
    """A finished frame with the fitted steps that made it."""

    frame: DataFrame
    imputer: Imputer
    scaler: Scaler | None


def create_dataset(
    tables: Tables,
    config: Config,
    cohort: str,
    lookback_days: int | None = 30,
    missing: str = "median",
    scale: str | None = "standard",
    min_count: int = 1,
    fit_on: str = "train",
    names: Names = Names(),
    splitter: Splitter | None = None,
    **match,
) -> Dataset:
    """Label, aggregate, filter, join, impute and scale.

    The joined frame is written once to the shared folder, because learning the
    fill values and the scale each scan it again. By default it is split first (column
    ``split``) and only the training part is learned from; ``fit_on='all'`` learns from every row.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    joined = stage(
        labelled_frame(tables, config, cohort, lookback_days, min_count, names, **match)
    )
    ids = (names.subject, "label", names.encounter, "split")
    if fit_on == "train":
        joined = stage((splitter or Splitter()).stratified(joined, "label", [names.subject]))
    learn = parts(joined)[0] if fit_on == "train" else joined
    imputer = Imputer(missing, ids).fit(learn)
    scaler = None
    if scale is not None:
        scaler = Scaler(scale, ids).fit(imputer.transform(learn))
    done = imputer.transform(joined)
    return Dataset(scaler.transform(done) if scaler else done, imputer, scaler)


def multi_cohort_labels(tables: Tables, config: Config, names: Names = Names(), **match) -> DataFrame:
    """(subject, cohort, label) for all configured cohorts from one pass."""
    return all_labels(
        tables.admissions(), tables.diagnoses(), config.code_rules(), names.subject,
        code=names.code, system=names.system, **match,
    )


def cohort_frames(
    features: DataFrame,
    labels: DataFrame,
    missing: str = "median",
    scale: str | None = "standard",
    fit_on: str = "train",
    subject: str = "subject_id",
    splitter: Splitter | None = None,
) -> Dataset:
    """One frame (subject, cohort, label, features) for all cohorts of ``labels``.

    Features do not depend on the cohort, so they are computed, written and fitted once, for the
    subjects that ``labels`` know, and only the labels (subject, cohort, label) are joined per cohort.
    ``fit_on='train'`` splits the subjects once (column ``split``), the same way for every cohort.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    known = features.join(labels.select(subject).distinct(), subject, "left_semi")
    once = stage(known)
    if fit_on == "train":
        once = stage((splitter or Splitter()).random(once, [subject]))
    ids = (subject, "split")
    learn = parts(once)[0] if fit_on == "train" else once
    imputer = Imputer(missing, ids).fit(learn)
    scaler = Scaler(scale, ids).fit(imputer.transform(learn)) if scale is not None else None
    done = imputer.transform(once)
    done = stage(scaler.transform(done) if scaler else done)
    columns = [c for c in done.columns if c != subject]
    return Dataset(labels.join(done, subject).select(subject, "cohort", "label", *columns), imputer, scaler)


def create_datasets(
    tables: Tables,
    config: Config,
    lookback_days: int | None = 30,
    missing: str = "median",
    scale: str | None = "standard",
    min_count: int = 1,
    fit_on: str = "train",
    names: Names = Names(),
    splitter: Splitter | None = None,
    **match,
) -> Dataset:
    """``create_dataset`` for every configured cohort from one scan of the observations.

    The frame is long, a row per subject and cohort; ``frame.where(cohort = ...)`` is one cohort's.
    """
    wide = feature_frame(
        tables.lab_results(), config.item_map(tables.spark), config.feature_names(), lookback_days, names.obs
    )
    labels = multi_cohort_labels(tables, config, names, **match)
    return cohort_frames(min_tests(wide, min_count), labels, missing, scale, fit_on, names.subject, splitter)
