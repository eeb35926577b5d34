"""Built-in rules for blood-count panels and five cohorts."""

from __future__ import annotations

from .config import Config

# Code lists, laboratory item ids, units, reference ranges and
# literature limits. They are data, not logic, and must not be changed.
_COHORTS = {  # cohort: (name, ninth revision codes, tenth revision codes)
    "rheumatoid_arthritis": (
        "Rheumatoid Arthritis",
        ["714.0", "714.1", "714.2", "714.3", "714.4", "714.8", "714.9"],
        ["M05", "M06"],
    ),
    "diabetes_type1": (
        "Diabetes Mellitus Type 1",
        ["250.01", "250.03", "250.11", "250.13", "250.31", "250.33"],
        ["E10"],
    ),
    "diabetes_type2": (
        "Diabetes Mellitus Type 2",
        ["250.00", "250.02", "250.10", "250.12", "250.30", "250.32"],
        ["E11"],
    ),
    "crohns_disease": (
        "Crohn's Disease",
        ["555.0", "555.1", "555.2", "555.9"],
        ["K50"],
    ),
    "psoriasis": (
        "Psoriasis",
        ["696.1"],
        ["L40"],
    ),
}
_FEATURES = [  # feature, item ids, unit, low, high
    ("hemoglobin", [51222, 50811], "g/dL", 12.0, 17.5),
    ("hematocrit", [51221, 50810], "%", 36.0, 50.0),
    ("rbc", [51279], "M/uL", 4.0, 5.5),
    ("mcv", [51250], "fL", 80.0, 100.0),
    ("mch", [51248], "pg", 27.0, 33.0),
    ("mchc", [51249], "g/dL", 32.0, 36.0),
    ("rdw", [51277], "%", 11.5, 14.5),
    ("wbc", [51301, 51300], "K/uL", 4.5, 11.0),
    ("neutrophils", [51256], "%", 40.0, 70.0),
    ("lymphocytes", [51244, 51245], "%", 20.0, 40.0),
    ("monocytes", [51254], "%", 2.0, 8.0),
    ("eosinophils", [51200], "%", 1.0, 4.0),
    ("basophils", [51146], "%", 0.0, 1.0),
    ("platelets", [51265], "K/uL", 150.0, 400.0),
    ("mpv", [51264], "fL", 7.5, 11.5),
]
_GROUPS = {
    "rbc_indices": ["hemoglobin", "hematocrit", "rbc", "mcv", "mch", "mchc", "rdw"],
    "wbc_differential": ["wbc", "neutrophils", "lymphocytes", "monocytes", "eosinophils", "basophils"],
    "platelet_indices": ["platelets", "mpv"],
    "core_cbc": ["hemoglobin", "hematocrit", "wbc", "platelets"],
}
_LIMITS = {  # cohort: (feature, low, high), ...
    "rheumatoid_arthritis": [
        ("hemoglobin", 12.0, 17.5),
        ("wbc", 4.5, 11.0),
        ("platelets", 150.0, 400.0),
        ("hematocrit", 36.0, 50.0),
        ("neutrophils", 40.0, 70.0),
        ("lymphocytes", 20.0, 40.0),
    ],
    "diabetes_type1": [
        ("wbc", 4.5, 11.0),
        ("neutrophils", 40.0, 70.0),
        ("lymphocytes", 20.0, 40.0),
        ("platelets", 150.0, 400.0),
    ],
    "diabetes_type2": [
        ("hemoglobin", 12.0, 17.5),
        ("wbc", 4.5, 11.0),
        ("platelets", 150.0, 400.0),
        ("hematocrit", 36.0, 50.0),
    ],
    "crohns_disease": [
        ("hemoglobin", 10.0, 17.5),
        ("hematocrit", 32.0, 50.0),
        ("wbc", 4.5, 11.0),
        ("platelets", 150.0, 450.0),
        ("mcv", 75.0, 100.0),
        ("rdw", 11.5, 16.0),
    ],
    "psoriasis": [
        ("wbc", 4.5, 11.0),
        ("neutrophils", 40.0, 70.0),
        ("platelets", 150.0, 400.0),
        ("lymphocytes", 20.0, 40.0),
    ],
}
_MODELS = {
    "default": "random_forest",
    "random_forest": {"trees": 100, "depth": 10, "min_rows": 5, "seed": 42},
    "boosted_trees": {"trees": 100, "depth": 6, "rate": 0.1, "seed": 42},
    "logistic_regression": {"max_iter": 1000},
    "explainer": {"background": 100},
    "cross_validation": {"use_cv": True, "folds": 5},
}


def default_config() -> Config:
    return Config(
        cohorts={
            key: {"name": name, "codes": {"9": nine, "10": ten}}
            for key, (name, nine, ten) in _COHORTS.items()
        },
        features={
            name: {"itemids": ids, "unit": unit, "low": low, "high": high}
            for name, ids, unit, low, high in _FEATURES
        },
        groups={key: list(names) for key, names in _GROUPS.items()},
        thresholds={
            key: {name: {"low": low, "high": high} for name, low, high in rows}
            for key, rows in _LIMITS.items()
        },
        models=_MODELS,
    )
