"""Univariate and model-based feature ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table, stage
from .grouped_fits import elimination_order
from .models import fit_logistic
from .prepare import column_quantiles
from .ranking import q, running_sums, text, unpivot

METHODS = ("mutual_info", "f_classif", "rfe", "lasso")


def f_scores(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, score): one-way ANOVA F of each feature over the classes, from one
    pass of counts, means and variances."""
    per_class = (
        unpivot(df, features, [label])
        .where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy("feature", label)
        .agg(
            F.expr("count(1) AS n"),
            F.expr("avg(value) AS m"),
            F.expr("coalesce(var_samp(value), 0D) AS v"),
        )
    )
    summed = per_class.groupBy("feature").agg(
        F.expr("sum(n) AS n"),
        F.expr("count(1) AS g"),
        F.expr("sum(n * m) AS nm"),
        F.expr("sum(n * m * m) AS nmm"),
        F.expr("sum((n - 1) * v) AS within"),
    )
    return summed.selectExpr(
        "feature",
        "try_divide(try_divide(nmm - nm * nm / n, g - 1), try_divide(within, n - g)) AS score",
    )


def mutual_information(
    df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10
) -> DataFrame:
    """(feature, score) in nats between the class and the feature cut at its exact
    quantiles into ``bins`` parts."""
    probs = {f"b{i}": i / bins for i in range(1, bins)}
    edges = column_quantiles(df, features, probs)
    cases = []
    for f in features:
        if f in edges:
            cuts = sorted(set(edges[f].values()))
            slot = " + ".join(f"CAST({q(f)} > {c!r}D AS INT)" for c in cuts)
            cases.append(
                f"struct({text(f)} AS feature,"
                f" CASE WHEN {q(f)} IS NOT NULL AND NOT isnan(CAST({q(f)} AS DOUBLE)) THEN {slot} END AS bin)"
            )
    counts = (
        df.selectExpr(q(label), f"inline(array({', '.join(cases)}))")
        .where(f"bin IS NOT NULL AND {q(label)} IS NOT NULL")
        .groupBy("feature", "bin", label)
        .agg(F.expr("CAST(count(1) AS DOUBLE) AS n"))
    )
    return (
        counts.selectExpr(
            "feature",
            "n",
            "sum(n) OVER (PARTITION BY feature, bin) AS nb",
            f"sum(n) OVER (PARTITION BY feature, {q(label)}) AS nl",
            "sum(n) OVER (PARTITION BY feature) AS nt",
        )
        .groupBy("feature")
        .agg(F.expr("sum(n / nt * ln(n * nt / (nb * nl))) AS score"))
    )


def lasso_scores(
    df: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0
) -> dict[str, float]:
    """Absolute coefficients of an L1-penalised logistic fit."""
    return {f: abs(w) for f, w in fit_logistic(df, features, label, c, l1=True).weights.items()}


class FeatureSelector:
    """Ranks features by one of ``METHODS`` and keeps the best ``k``."""

    def __init__(self, method: str = "mutual_info", k: int = 10):
        if method not in METHODS:
            raise ValueError(f"method must be one of {list(METHODS)}, not {method!r}")
        self.method = method
        self.k = k
        self.scores: dict[str, float] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> "FeatureSelector":
        if self.method == "rfe":
            order = elimination_order(df, features, label, min(self.k, len(features)))
            self.scores = {f: float(len(order) - i) for i, f in enumerate(order)}
        elif self.method == "lasso":
            self.scores = lasso_scores(df, features, label)
        else:
            scorer = f_scores if self.method == "f_classif" else mutual_information
            rows = {r["feature"]: r["score"] for r in scorer(df, features, label).collect()}
            self.scores = {f: rows.get(f) or 0.0 for f in features}
        return self

    def ranking(self) -> list[tuple[str, float]]:
        if self.scores is None:
            raise RuntimeError("selector is not fitted; call fit first")
        return sorted(self.scores.items(), key=lambda t: -t[1])

    def selected(self) -> list[str]:
        return [f for f, _ in self.ranking()[: self.k]]

    def transform(self, df: DataFrame) -> DataFrame:
        dropped = set(self.scores or {}) - set(self.selected())
        return df.drop(*dropped)


# --- agreement of two rankings ----------------------------------------------


def rank_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman and Kendall (tau-b) correlation of two columns, one row
    ``(n, spearman, kendall)``; rows with a missing value are left out.

    The ranks of both columns come from one ``running_sums`` over (column, value). Discordant
    pairs are counted without forming pairs: two rows differ first at one bit of their dense rank
    in ``b``, so per (bit, higher bits) group it suffices to sum, along ``a``, the ones seen
    before each zero; a second ``running_sums`` takes all bits at once. Ties, moments and
    discordant pairs are read in one action, so the number of jobs does not depend on the data.
    """
    rows = df.selectExpr(f"CAST({q(a)} AS DOUBLE) AS a", f"CAST({q(b)} AS DOUBLE) AS b").where(
        "a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)"
    )
    cells = stage(rows.groupBy("a", "b").agg(F.expr("count(1) AS n")))
    sides = (
        cells.selectExpr("inline(array(struct('a' AS side, a AS v, n AS n), struct('b' AS side, b AS v, n AS n)))")
        .groupBy("side", "v")
        .agg(F.expr("sum(n) AS n"))
    )
    ranks = stage(running_sums(sides, "v", {"n": "n", "d": "1L"}, ["side"]))
    rank = "n_before + (n + 1) / 2D"
    ra = ranks.where("side = 'a'").selectExpr("v AS a", f"{rank} AS ra")
    rb = ranks.where("side = 'b'").selectExpr("v AS b", f"{rank} AS rb", "d_before AS dense", "d_total")
    joined = stage(cells.join(ra, "a").join(rb, "b"))
    bits = "sequence(0, greatest(0, CAST(ceil(log2(greatest(d_total, 2))) AS INT) - 1))"
    levels = joined.selectExpr("a", "n", "dense", f"explode({bits}) AS lvl").selectExpr(
        "a",
        "lvl",
        "shiftright(dense, lvl + 1) AS head",
        "CASE WHEN shiftright(dense, lvl) % 2 = 1 THEN n ELSE 0L END AS ones",
        "CASE WHEN shiftright(dense, lvl) % 2 = 0 THEN n ELSE 0L END AS zeros",
    )
    along = running_sums(levels, "a", {"ones": "ones", "zeros": "zeros"}, ["lvl", "head"])
    pairs = "sum(CAST(n AS DOUBLE) * (n - 1) / 2)"
    parts = [
        along.selectExpr("'discordant' AS k", "sum(CAST(zeros AS DOUBLE) * ones_before) AS v"),
        ranks.groupBy(F.expr("concat('ties_', side) AS k")).agg(F.expr(f"{pairs} AS v")),
        joined.selectExpr(
            "CAST(sum(n) AS DOUBLE) AS n", f"{pairs} AS both", "sum(n * ra) AS sa", "sum(n * rb) AS sb",
            "sum(n * ra * ra) AS saa", "sum(n * rb * rb) AS sbb", "sum(n * ra * rb) AS sab",
        ).selectExpr("stack(7, 'n', n, 'both', both, 'sa', sa, 'sb', sb, 'saa', saa, 'sbb', sbb, 'sab', sab) AS (k, v)"),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = {r["k"]: r["v"] or 0.0 for r in found.collect()}
    n = int(sums["n"])
    spearman = kendall = None
    if n > 1:
        cov = sums["sab"] / n - sums["sa"] / n * sums["sb"] / n
        va = sums["saa"] / n - (sums["sa"] / n) ** 2
        vb = sums["sbb"] / n - (sums["sb"] / n) ** 2
        spearman = cov / (va * vb) ** 0.5 if va > 0 and vb > 0 else None
        total = n * (n - 1) / 2
        apart_a, apart_b = total - sums["ties_a"], total - sums["ties_b"]
        discordant = sums["discordant"]
        concordant = apart_a - sums["ties_b"] + sums["both"] - discordant
        width = (apart_a * apart_b) ** 0.5
        kendall = (concordant - discordant) / width if width else None
    return local_table(
        df.sparkSession, [(n, spearman, kendall)], "n bigint, spearman double, kendall double"
    )


def importance_agreement(
    spark, first: Mapping[str, float], second: Mapping[str, float]
) -> dict[str, float | None]:
    """Spearman, Kendall and Pearson correlation of two feature -> importance maps
    over their common features."""
    common = [f for f in first if f in second]
    table = local_table(
        spark, [(f, float(first[f]), float(second[f])) for f in common], "feature string, a double, b double"
    )
    row = rank_agreement(table, "a", "b").first()
    pearson = table.selectExpr(
        "try_divide(covar_pop(a, b), stddev_pop(a) * stddev_pop(b)) AS r"
    ).first()["r"]
    return {"spearman": row["spearman"], "kendall": row["kendall"], "pearson": pearson}
