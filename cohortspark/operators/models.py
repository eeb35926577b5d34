"""Classifiers of Spark ML behind one small interface."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_columns
from .ranking import q

KINDS = ("random_forest", "boosted_trees", "logistic_regression")
_ALIASES = {
    "randomforest": "random_forest",
    "xgboost": "boosted_trees",
    "gbt": "boosted_trees",
    "logisticregression": "logistic_regression",
}
VECTOR = "__features"


def model_kind(name: str) -> str:
    kind = _ALIASES.get(name.replace("_", "").lower(), name)
    if kind not in KINDS:
        raise ValueError(f"unknown model {name!r}; must be one of {list(KINDS)}")
    return kind


@dataclass(frozen=True)
class Fitted:
    """A fitted classifier and the features it reads, in order."""

    kind: str
    features: tuple[str, ...]
    model: object

    @property
    def weights(self) -> dict[str, float]:
        """Logistic coefficients, or a tree model's own importances."""
        values = (
            self.model.coefficients
            if self.kind == "logistic_regression"
            else self.model.featureImportances
        )
        return dict(zip(self.features, (float(v) for v in values.toArray())))

    @property
    def intercept(self) -> float:
        return float(self.model.intercept)

    def strongest(self, among: Sequence[str]) -> str:
        """Largest absolute weight; the earliest feature on a tie."""
        weights = self.weights
        return max(among, key=lambda f: (abs(weights[f]), -self.features.index(f)))

    def predict(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` columns (all by default) plus ``probability`` of class 1 and the
        0/1 ``prediction``."""
        base = df.columns if keep is None else list(keep)
        scored = self.model.transform(assemble(df, self.features))
        return scored.select(
            *[F.col(c) for c in base],
            vector_to_array("__probability")[1].alias("probability"),
            F.col("__prediction").cast("int").alias("prediction"),
        )


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` plus the feature vector; a missing feature value fails the job."""
    require_columns(df, features, "model frame")
    values = ", ".join(f"CAST({q(f)} AS DOUBLE)" for f in features)
    complete = (
        "if(exists(__values, x -> x IS NULL OR isnan(x)),"
        " raise_error('a feature value is missing; impute first'), __values)"
    )
    return (
        df.selectExpr("*", f"array({values}) AS __values")
        .withColumn(VECTOR, array_to_vector(F.expr(complete)))
        .drop("__values")
    )


def _columns() -> dict:
    return {
        "featuresCol": VECTOR,
        "labelCol": "__label",
        "predictionCol": "__prediction",
        "probabilityCol": "__probability",
        "rawPredictionCol": "__raw",
    }


def _training(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    known = df.where(f"{q(label)} IS NOT NULL")
    return assemble(known, features).select(VECTOR, F.col(label).cast("double").alias("__label"))


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    c: float | None = 1.0,
    max_iter: int = 1000,
    l1: bool = False,
) -> Fitted:
    """Logistic regression on the features as they are. ``c`` is the inverse penalty
    of the summed loss, so the penalty on Spark's mean loss is ``1 / (c * n)``;
    ``None`` fits without a penalty."""
    train = _training(df, features, label)
    penalty = 0.0
    if c is not None:
        penalty = 1.0 / (c * max(1, df.where(f"{q(label)} IS NOT NULL").count()))
    model = LogisticRegression(
        maxIter=max_iter,
        regParam=penalty,
        elasticNetParam=1.0 if l1 else 0.0,
        standardization=c is None,
        **_columns(),
    ).fit(train)
    return Fitted("logistic_regression", tuple(features), model)


def fit_model(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    kind: str = "random_forest",
    settings: Mapping | None = None,
) -> Fitted:
    kind = model_kind(kind)
    s = dict(settings or {})
    seed = s.get("seed", 42)
    if kind == "logistic_regression":
        return fit_logistic(df, features, label, s.get("c", 1.0), s.get("max_iter", 1000))
    if kind == "random_forest":
        estimator = RandomForestClassifier(
            numTrees=s.get("trees", 100),
            maxDepth=s.get("depth", 10),
            minInstancesPerNode=max(1, s.get("min_rows", 5) // 2),
            seed=seed,
            **_columns(),
        )
    else:
        estimator = GBTClassifier(
            maxIter=s.get("trees", 100),
            maxDepth=s.get("depth", 6),
            stepSize=s.get("rate", 0.1),
            seed=seed,
            featuresCol=VECTOR,
            labelCol="__label",
            predictionCol="__prediction",
        )
        estimator.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    return Fitted(kind, tuple(features), estimator.fit(_training(df, features, label)))


class Baseline:
    """A classifier with fit / predict / predict_proba over named feature columns."""

    def __init__(self, kind: str = "logistic_regression", **settings):
        self.kind = model_kind(kind)
        self.settings = settings
        self.fitted: Fitted | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> "Baseline":
        self.fitted = fit_model(df, features, label, self.kind, self.settings)
        return self

    def _ready(self) -> Fitted:
        if self.fitted is None:
            raise RuntimeError("model is not fitted; call fit first")
        return self.fitted

    def predict(self, df: DataFrame) -> DataFrame:
        return self._ready().predict(df).drop("probability")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._ready().predict(df).drop("prediction")

    def params(self) -> dict:
        return {"kind": self.kind, **self.settings}
