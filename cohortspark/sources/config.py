"""Cohort and feature rules: YAML on the driver, small rule tables for Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.codes import strip_wildcard
from ..session import local_table


@dataclass(frozen=True)
class CodeRule:
    """Facts whose code starts with ``prefix`` (in ``system``) belong to ``cohort``."""

    cohort: str
    system: str
    prefix: str


@dataclass(frozen=True)
class Config:
    """Everything the operators need to know about codes, items and limits.

    ``cohorts``    key -> {"name": text, "codes": {system: [code, range, ...]}}
    ``features``   feature -> {"itemids": [...], "unit": text, "low": x, "high": y}
    ``groups``     group -> ordered feature list
    ``thresholds`` cohort -> feature -> number or {"low": x, "high": y}
    ``models``     "default" kind, settings by model kind, "explainer", "cross_validation"
    ``default_cohort`` the cohort to begin with, if one is named
    """

    cohorts: Mapping[str, Mapping] = field(default_factory=dict)
    features: Mapping[str, Mapping] = field(default_factory=dict)
    groups: Mapping[str, list] = field(default_factory=dict)
    thresholds: Mapping[str, Mapping] = field(default_factory=dict)
    models: Mapping[str, Mapping] = field(default_factory=dict)
    default_cohort: str | None = None

    def cohort(self, key: str) -> Mapping:
        if key not in self.cohorts:
            raise ValueError(f"unknown cohort {key!r}; known: {list(self.cohorts)}")
        return self.cohorts[key]

    def code_rules(self, cohorts: Iterable[str] | None = None) -> list[CodeRule]:
        keys = list(self.cohorts) if cohorts is None else list(cohorts)
        return [
            CodeRule(key, str(system), prefix)
            for key in keys
            for system, codes in self.cohort(key).get("codes", {}).items()
            for code in codes
            for prefix in expand_code(str(code))
        ]

    def relevant_features(self, cohort: str) -> list[str]:
        """The features configured for a cohort, else all."""
        return list(self.cohort(cohort).get("relevant") or self.feature_names())

    def model(self, kind: str | None = None) -> tuple[str, dict]:
        """(kind, settings) of a configured model; the default kind without a name."""
        kind = kind or self.models.get("default", "random_forest")
        return kind, dict(self.models.get(kind) or {})

    def validation(self) -> dict:
        """``use_cv`` and ``n_folds`` as the Youden finders take them."""
        own = self.models.get("cross_validation") or {}
        return {"use_cv": bool(own.get("use_cv", True)), "n_folds": int(own.get("folds", 5))}

    def item_ids(self) -> list:
        return [i for f in self.features.values() for i in f.get("itemids", [])]

    def feature_names(self) -> list[str]:
        return list(self.features)

    def item_map(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name) for name, f in self.features.items() for i in f["itemids"]]
        kind = "int" if all(isinstance(i, int) for i, _ in rows) else "string"
        return local_table(spark, rows, f"itemid {kind}, feature string")

    def ref_ranges(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, _number(f.get("low")), _number(f.get("high")), f.get("unit"))
            for name, f in self.features.items()
        ]
        return local_table(spark, rows, "feature string, low double, high double, unit string")

    def lit_thresholds(self, spark: SparkSession) -> DataFrame:
        """Thresholds per cohort and feature; a cohort without any falls back to
        the reference ranges."""
        rows = []
        for key in self.cohorts:
            for name, limit in self.thresholds_for(key).items():
                if isinstance(limit, Mapping):
                    rows.append((key, name, _number(limit.get("low")), _number(limit.get("high"))))
                else:
                    rows.append((key, name, None, _number(limit)))
        return local_table(spark, rows, "cohort string, feature string, low double, high double")

    def thresholds_for(self, cohort: str) -> dict:
        """Configured limits of a cohort, else the reference ranges."""
        own = self.thresholds.get(cohort)
        if own:
            return dict(own)
        return {
            name: {"low": f["low"], "high": f["high"]}
            for name, f in self.features.items()
            if f.get("low") is not None or f.get("high") is not None
        }

    def feature_groups(self, spark: SparkSession) -> DataFrame:
        rows = [
            (group, name, pos)
            for group, names in self.groups.items()
            for pos, name in enumerate(names)
        ]
        return local_table(spark, rows, "group string, feature string, pos int")


def _number(value) -> float | None:
    return None if value is None else float(value)


_END = re.compile(r"^(?P<letters>[A-Za-z]*)(?P<stem>\d+)(?:\.(?P<rest>\d+))?$")


def expand_code(code: str) -> list[str]:
    """Prefixes for a code; a trailing ``x`` or dot is a wildcard.

    A range counts through the digits of both ends, which keep their width and dot:
    ``714.0-714.2``, ``714-716``, ``714.8-715.1``, ``M05-M14``. Any other text with a hyphen raises
    ``ValueError``, as does a range that runs backwards.
    """
    code = code.strip()
    if "-" not in code:
        return [strip_wildcard(code)]
    ends = [_END.match(end.strip()) for end in code.split("-")]
    shapes = {e and (e["letters"], len(e["stem"]), len(e["rest"] or "")) for e in ends}
    if len(ends) != 2 or None in shapes or len(shapes) != 1:
        raise ValueError(f"cannot expand the code range {code!r}")
    letters, stem, rest = shapes.pop()
    first, last = (int(e["stem"] + (e["rest"] or "")) for e in ends)
    if last < first:
        raise ValueError(f"the code range {code!r} runs backwards")
    digits = [f"{i:0{stem + rest}d}" for i in range(first, last + 1)]
    return [letters + d[:stem] + ("." + d[stem:] if rest else "") for d in digits]


# Names of model settings in configuration files, and here.
_SETTINGS = {
    "n_estimators": "trees",
    "max_depth": "depth",
    "min_samples_split": "min_rows",
    "learning_rate": "rate",
    "max_iter": "max_iter",
    "random_state": "seed",
    "c": "c",
}
_KINDS = {"randomforest": "random_forest", "xgboost": "boosted_trees", "logisticregression": "logistic_regression"}


def _kind(name: str) -> str:
    plain = str(name).replace("_", "").lower()
    kind = _KINDS.get(plain, str(name))
    if kind not in _KINDS.values():
        raise ValueError(f"unknown model type {name!r}; known: {sorted(_KINDS.values())}")
    return kind


def _settings(body: Mapping, where: str) -> dict:
    known = {**_SETTINGS, **{v: v for v in _SETTINGS.values()}}
    unknown = [k for k in body if k != "model_type" and k.lower() not in known]
    if unknown:
        raise ValueError(f"unknown setting(s) {unknown} in {where}; known: {sorted(_SETTINGS)}")
    return {known[k.lower()]: v for k, v in body.items() if k != "model_type"}


def parse_models(body: Mapping) -> dict:
    """The model section by kind; unknown keys raise ``ValueError``."""
    unknown = set(body) - {"default_model", "models", "explainer", "cross_validation"}
    if unknown:
        raise ValueError(f"unknown model section(s) {sorted(unknown)}")
    out: dict = {}
    for name, own in (body.get("models") or {}).items():
        out[_kind(own.get("model_type", name))] = _settings(own, f"models.{name}")
    default = body.get("default_model") or {}
    if default:
        kind = _kind(default.get("model_type", "random_forest"))
        out["default"] = kind
        out[kind] = {**out.get(kind, {}), **_settings(default, "default_model")}
    folds = dict(body.get("cross_validation") or {})
    strange = set(folds) - {"use_cv", "cv_folds"}
    if strange:
        raise ValueError(f"unknown setting(s) {sorted(strange)} in cross_validation")
    if folds:
        out["cross_validation"] = {"use_cv": folds.get("use_cv", True), "folds": folds.get("cv_folds", 5)}
    if body.get("explainer"):
        out["explainer"] = dict(body["explainer"])
    return out


def load_config(folder: str) -> Config:
    """Merge the YAML files of ``folder``; a missing file or folder gives no rules.

    Sections: ``diseases`` or ``cohorts`` (with ``icd9_codes``-style lists or a
    ``codes`` map), any ``*_features`` section with ``itemids``, ``feature_groups``,
    ``literature_thresholds`` and ``*_config``.
    """
    import yaml

    merged: dict = {}
    root = Path(folder)
    for path in sorted(root.glob("*.y*ml")) if root.is_dir() else []:
        merged.update(yaml.safe_load(path.read_text()) or {})
    return parse_config(merged)


def parse_config(raw: Mapping) -> Config:
    cohorts = {}
    for key, body in (raw.get("cohorts") or raw.get("diseases") or {}).items():
        codes = dict(body.get("codes") or {})
        for name, values in body.items():
            match = re.fullmatch(r"\D*(\d+)_codes", name)
            if match:
                codes[match.group(1)] = values or []
        cohorts[key] = {"name": body.get("name", key), "codes": codes}
        if body.get("relevant_biomarkers"):
            cohorts[key]["relevant"] = list(body["relevant_biomarkers"])
    features, models = {}, {}
    for section, body in raw.items():
        if section.endswith("_features") or section == "features":
            for name, f in body.items():
                span = f.get("reference_range") or f
                features[name] = {
                    "itemids": list(f.get("itemids", [])),
                    "unit": f.get("unit"),
                    "low": span.get("low"),
                    "high": span.get("high"),
                }
        elif section.endswith("_config"):
            models = parse_models(body)
    return Config(
        cohorts=cohorts,
        features=features,
        groups=raw.get("feature_groups") or {},
        thresholds=raw.get("literature_thresholds") or {},
        models=models,
        default_cohort=raw.get("default_disease"),
    )
