"""Shapley attribution of a classifier's output to its features.

Every method returns one row per (row key, feature): ``feature, value, phi``. For
linear models ``phi`` explains the log-odds, for forests the probability of class
1, for boosted trees the margin, for the sampled method the probability.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_table, require_columns, shared_folder, stage
from .models import VECTOR, Fitted
from .ranking import hash_key, q, qs, text

# The batch function travels with the job: executors need numpy and pandas only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Nodes of the trees that one pass over the rows explains; larger models take more passes.
PASS_NODES = 500_000
# Doubles held at once while explaining a batch.
WORK_CELLS = 3_000_000
# Feature values that a task explains at once: what is worked out for a tree serves all these rows.
BLOCK_CELLS = 4_000_000
# Rows looked up at once, so that their values stay in the processor's cache.
LOOKUP_ROWS = 8_192
# Most tests that leaves with a common table may have between them: a table has a column per outcome.
UNIT_TESTS = 12


def attribute(
    model: Fitted, df: DataFrame, keys: Sequence[str], method: str | None = None, **options
) -> DataFrame:
    """Attribution by the method that fits the model: closed form for logistic
    regression, tree paths for tree ensembles; ``method='sampled'`` works for all."""
    require_columns(df, [*keys, *model.features], "attribution frame")
    chosen = method or ("linear" if model.kind == "logistic_regression" else "tree")
    if chosen == "linear":
        return linear_attribution(df, model.features, model.weights, keys)
    if chosen == "tree":
        return tree_attribution(model, df, keys, **options)
    if chosen == "sampled":
        return sampled_attribution(model, df, keys, **options)
    raise ValueError(f"method must be 'linear', 'tree' or 'sampled', not {method!r}")


def _long(df: DataFrame, features: Sequence[str], keys: Sequence[str], phi: Sequence[str]) -> DataFrame:
    triples = ", ".join(
        f"struct({text(f)} AS feature, CAST({q(f)} AS DOUBLE) AS value, {e} AS phi)"
        for f, e in zip(features, phi)
    )
    return df.selectExpr(*qs(keys), f"inline(array({triples}))")


# --- linear ------------------------------------------------------------------


def linear_attribution(
    df: DataFrame,
    features: Sequence[str],
    weights: Mapping[str, float],
    keys: Sequence[str],
    background: DataFrame | None = None,
) -> DataFrame:
    """``weight * (x - mean)`` with the means of ``background`` (default ``df``)."""
    means = (background if background is not None else df).selectExpr(
        *[f"avg(CAST({q(f)} AS DOUBLE)) AS m{i}" for i, f in enumerate(features)]
    ).first()
    phi = [
        f"{float(weights[f])!r}D * (CAST({q(f)} AS DOUBLE) - {float(means[f'm{i}'] or 0.0)!r}D)"
        for i, f in enumerate(features)
    ]
    return _long(df, features, keys, phi)


# --- trees -------------------------------------------------------------------


def node_table(model: Fitted, spark) -> DataFrame:
    """The nodes of a fitted ensemble as Spark stores them."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.model.save(path)
    return spark.read.parquet(f"{path}/data").selectExpr(
        "treeID AS tree",
        "nodeData.id AS id",
        "nodeData.prediction AS prediction",
        "nodeData.impurityStats AS stats",
        "CAST(nodeData.rawCount AS DOUBLE) AS cover",
        "nodeData.leftChild AS left",
        "nodeData.rightChild AS right",
        "nodeData.split.featureIndex AS feature",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) AS cut",
    )


def tree_passes(nodes: DataFrame, limit: int | None = None) -> list[list[int]]:
    """Trees in groups of at most ``limit`` nodes (a larger tree alone), in order."""
    groups, size = [], 0
    for tree, count in sorted(map(tuple, nodes.groupBy("tree").count().collect())):
        if not groups or size + count > (limit or PASS_NODES):
            groups.append([])
            size = 0
        groups[-1].append(tree)
        size += count
    return groups


def leaf_table(model: Fitted, nodes: DataFrame) -> list[tuple]:
    """Leaves of each tree in ``nodes``, neighbours in the tree next to each other.

    A tree is (features, lower, upper, share, value), a row per leaf: a leaf is reached when
    every feature of its path lies in (lower, upper]; ``share`` is the part of the training rows
    that follow the path's splits on that feature. Paths with fewer features than the tree's
    longest end in entries that hold for every row: unbounded, with share 1.
    """
    table = nodes.toPandas()
    tree_weights = model.model.treeWeights
    forest = model.kind == "random_forest"
    total = sum(tree_weights)
    out = []
    for tree, part in table.groupby("tree"):
        part = part.set_index("id")
        rows = part.to_dict("index")
        leaves, todo = [], [(0, {})]
        while todo:
            at, path = todo.pop()
            node = rows[at]
            if node["left"] < 0:
                if forest:
                    value = node["stats"][1] / sum(node["stats"]) * tree_weights[tree] / total
                else:
                    value = node["prediction"] * tree_weights[tree]
                leaves.append((path, value))
                continue
            f, cut = node["feature"], node["cut"]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, lo, hi in (
                (node["left"], low, min(high, cut)),
                (node["right"], max(low, cut), high),
            ):
                part_share = share * rows[child]["cover"] / node["cover"]
                todo.append((child, {**path, f: (lo, hi, part_share)}))
        size = max(len(p) for p, _ in leaves)
        fill = [[(-np.inf, np.inf, 1.0)] * (size - len(p)) for p, _ in leaves]
        features = np.array([[*p, *[0] * len(e)] for (p, _), e in zip(leaves, fill)], dtype=np.int32).reshape(-1, size)
        spans = np.array([[*p.values(), *e] for (p, _), e in zip(leaves, fill)]).reshape(-1, size, 3)
        out.append((features, spans[..., 0], spans[..., 1], spans[..., 2], np.array([v for _, v in leaves])))
    return out


def tree_base(leaves: list[tuple]) -> float:
    """Mean model output over the training rows, from the leaf shares."""
    return float(sum((g[4] * g[3].prod(axis=1)).sum() for g in leaves))


def _nodes_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Quadrature on (0, 1), exact for the products of ``size`` - 1 factors."""
    u, w = np.polynomial.legendre.leggauss((size + 1) // 2)
    return (u + 1) / 2, w / 2


def _row_values(x: np.ndarray, features, low, high, share, value) -> np.ndarray:
    """Attributions of a batch (rows, features), each leaf worked out for each row."""
    phi = np.zeros(x.shape)
    count, size = features.shape
    u, w = _nodes_of(size)
    step = max(1, WORK_CELLS // (size * len(x)))
    for a in range(0, count, step):
        f, z, v = features[a : a + step], share[a : a + step], value[a : a + step]
        inside = ((x[:, f] > low[a : a + step]) & (x[:, f] <= high[a : a + step])).astype(float)
        weight = np.zeros(inside.shape)
        for ui, wi in zip(u, w):
            factor = z * (1 - ui) + inside * ui
            weight += wi * factor.prod(axis=2, keepdims=True) / factor
        part = (weight * (inside - z) * v[:, None]).reshape(len(x), -1)
        order = np.argsort(f.ravel(), kind="stable")
        names, starts = np.unique(f.ravel()[order], return_index=True)
        phi[:, names] += np.add.reduceat(part[:, order], starts, axis=1)
    return phi


def _pattern_values(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(leaves, path features, patterns): the attributions for every choice of the path features
    that lie inside, bit i of a pattern standing for feature i."""
    count, size = share.shape
    u, w = _nodes_of(size)
    outside = share[:, :, None] * (1 - u)
    product = np.ones((count, len(u), 1))
    for i in range(size):
        factor = outside[:, i, :, None]
        product = np.concatenate([product * factor, product * (factor + u[:, None])], axis=2)
    scale = w * value[:, None, None]
    return np.where(
        np.arange(2**size) >> np.arange(size)[:, None] & 1,
        ((1 - share)[:, :, None] * scale / (outside + u)) @ product,
        (-share[:, :, None] * scale / outside) @ product,
    )


def _units(features, low, high, most: int) -> Iterator[tuple[int, int, list]]:
    """Neighbouring leaves that have at most ``most`` tests between them (or one leaf): first, end,
    and the tests ``feature <= cut``."""
    start, tests = 0, set()
    for a in range(len(features)):
        bounds = zip(features[a].tolist(), low[a].tolist(), high[a].tolist())
        mine = {(f, cut) for f, lo, hi in bounds for cut in (lo, hi) if np.isfinite(cut)}
        if a > start and len(tests | mine) > most:
            yield start, a, sorted(tests)
            start, tests = a, set()
        tests |= mine
    yield start, len(features), sorted(tests)


def _unit_table(tests: list, features, low, high, share, value) -> tuple[list[int], np.ndarray]:
    """The features of some leaves, and their attributions by the outcomes of the leaves' tests."""
    sizes = (np.isfinite(low) | np.isfinite(high)).sum(axis=1)
    size = int(sizes.max())
    place = {test: j for j, test in enumerate(tests)}
    names = sorted({f for f, _ in tests})
    row = {f: j for j, f in enumerate(names)}
    # inside is passing the upper bound (or having none) less passing the lower one: no row passes only the lower
    bits = 2 ** np.arange(size)
    steps = np.zeros((len(value), len(tests), 1), dtype=np.intp)
    pattern = (np.isinf(high[:, :size]) @ bits)[:, None].astype(np.intp)
    for bound, sign in ((high, 1), (low, -1)):
        for a, i in np.argwhere(np.isfinite(bound)).tolist():
            steps[a, place[int(features[a, i]), float(bound[a, i])]] += sign * 2**i
    for j in range(len(tests)):
        pattern = np.concatenate([pattern, pattern + steps[:, j]], axis=1)
    table = np.zeros((len(names), 2 ** len(tests)))
    games = _pattern_values(share[:, :size], value)
    for a, own in enumerate(sizes.tolist()):
        for i, f in enumerate(features[a, :own].tolist()):
            table[row[f]] += games[a, i].take(pattern[a], mode="clip")
    return names, table


def explain_batch(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Path-dependent Shapley values of a batch (rows, features).

    A leaf is a product game over the features of its path. The Shapley weights are
    Beta integrals, so a leaf's value for feature i is the integral over u of the
    product of the other factors ``share * (1 - u) + inside * u``, a polynomial that
    Gauss-Legendre quadrature integrates exactly.

    The values depend on a row only through the outcomes of the leaves' tests. So neighbouring leaves
    with few tests between them get one table with a column per outcome, which every row looks up.
    Leaves with more outcomes than there are rows are worked out row by row.
    """
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    most = len(x).bit_length() - 1
    for tree in leaves:
        features, low, high, _, _ = tree
        if not len(x) or not features.size:
            continue
        tests = np.isfinite(low).sum(axis=1) + np.isfinite(high).sum(axis=1)
        if (tests > most).any():
            rest = [part[tests > most] for part in tree]
            for r in range(0, len(x), 2_000):
                phi[:, r : r + 2_000] += _row_values(x[r : r + 2_000], *rest).T
        tree = [part[tests <= most] for part in tree]
        if not len(tree[0]):
            continue
        for start, end, tests in _units(*tree[:3], min(UNIT_TESTS, most)):
            names, table = _unit_table(tests, *[part[start:end] for part in tree])
            for r in range(0, len(x), LOOKUP_ROWS):
                rows = slice(r, r + LOOKUP_ROWS)
                outcome = np.zeros(len(x[rows]), dtype=np.int32)
                for f, cut in reversed(tests):
                    outcome += outcome
                    outcome += columns[f, rows] <= cut
                outcome = outcome.astype(np.intp)
                for f, values in zip(names, table):
                    phi[f, rows] += values.take(outcome, mode="clip")
    return phi.T


def tree_attribution(
    model: Fitted, df: DataFrame, keys: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Exact path-dependent tree attribution, row batches on the executors.

    The leaves of a bounded group of trees are broadcast at a time; each group's pass adds to the
    values of the one before. Every row needs every feature: a missing one raises. Rows stay in
    their partitions unless ``partitions`` spreads a frame of few files over more cores.
    """
    spark = df.sparkSession
    features = list(model.features)
    nodes = node_table(model, spark)
    kept = df.selectExpr(*qs(keys), *[f"CAST({q(f)} AS DOUBLE) AS {q(f)}" for f in features])
    if partitions:
        kept = kept.repartition(partitions)
    schema = T.StructType([*kept.schema.fields, T.StructField("__phi", T.ArrayType(T.DoubleType()))])

    block = max(1, BLOCK_CELLS // len(features))

    def explainer(shared):
        def finished(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            phi = explain_batch(np.concatenate([pdf[features].to_numpy(dtype=float) for pdf in held]), shared.value)
            start = 0
            for pdf in held:
                part = list(phi[start : start + len(pdf)])
                start += len(pdf)
                if "__phi" in pdf:
                    part = [old + new for old, new in zip(pdf["__phi"], part)]
                yield pdf.assign(__phi=part)

        def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, rows = [], 0
            for pdf in batches:
                if pdf[features].isna().to_numpy().any():
                    raise ValueError("tree attribution needs every feature of every row")
                held.append(pdf)
                rows += len(pdf)
                if rows >= block:
                    yield from finished(held)
                    held, rows = [], 0
            if held:
                yield from finished(held)

        return explain

    explained = kept
    for trees in tree_passes(nodes):
        leaves = leaf_table(model, nodes.where(F.col("tree").isin(trees)))
        explained = explained.mapInPandas(explainer(spark.sparkContext.broadcast(leaves)), schema)
    return _long(explained, features, keys, [f"__phi[{i}]" for i in range(len(features))])


# --- sampled -----------------------------------------------------------------


def background_pool(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], n: int | None = None, seed: int = 42
) -> tuple[DataFrame, int]:
    """(``__b``, ``__ref``): background rows numbered from 0, and how many there are.

    All rows by default, numbered by written partition; with ``n`` the first in seeded hash order.
    """
    reference = f"array({', '.join(f'CAST({q(f)} AS DOUBLE)' for f in features)}) AS __ref"
    if n is not None:
        rows = df.selectExpr(reference, f"{hash_key(keys, seed)} AS __h").orderBy("__h").limit(n).collect()
        pool = local_table(df.sparkSession, [(i, list(r[0])) for i, r in enumerate(rows)], "__b long, __ref array<double>")
        return pool, len(rows)
    written = stage(df.selectExpr(reference, "monotonically_increasing_id() AS __id"))
    part = F.shiftright("__id", 33)
    sizes = sorted(map(tuple, written.groupBy(part).count().collect()))
    starts, total = [], 0
    for partition, size in sizes:
        starts.append((partition, total))
        total += size
    offsets = local_table(df.sparkSession, starts, "__part long, __start long")
    numbered = written.withColumn("__part", part).join(offsets, "__part").selectExpr(
        "__start + (__id & 8589934591L) AS __b", "__ref"
    )
    return numbered, total


def sampled_attribution(
    model: Fitted,
    df: DataFrame,
    keys: Sequence[str],
    background: DataFrame | None = None,
    samples: int | None = None,
    permutations: int = 8,
    seed: int = 42,
    output: str = "probability",
) -> DataFrame:
    """Attribution of any classifier by antithetic permutation sampling, with its standard error.

    A pair is one background row and one seeded feature order: the row is walked to from the
    background row in that order and in its reverse, and every step's change in the model's output
    goes to the feature switched at that step. ``permutations`` counts walks, rounded up to whole
    pairs. ``phi`` is the mean over the pairs, ``se`` the standard error of that mean (null for
    one pair). Background rows are drawn from all of ``background`` (``samples`` limits them).

    Walks are dealt by row key before they are expanded into steps, so the steps are scored and
    summed inside the task that made them; only pairs move. Work is rows x permutations x
    (features + 1) model evaluations. The values of a row always add up to its output minus the
    mean output of its background rows. ``output='log_odds'`` explains the log-odds instead.
    ``keys`` must tell rows apart.
    """
    outputs = {
        "probability": "__p[1]",
        "log_odds": "ln(__p[1]) - ln(__p[0])",
    }
    if output not in outputs:
        raise ValueError(f"output must be one of {sorted(outputs)}, not {output!r}")
    if permutations < 1:
        raise ValueError(f"permutations must be at least 1, not {permutations}")
    features = list(model.features)
    k = len(features)
    pairs = (int(permutations) + 1) // 2
    pool, size = background_pool(background if background is not None else df, features, keys, samples, seed)
    if not size:
        raise ValueError("background has no rows")
    seeded = ", ".join([str(int(seed)), *qs(keys), "__pair"])
    drawn = (
        df.selectExpr(
            *qs(keys),
            f"array({', '.join(f'CAST({q(f)} AS DOUBLE)' for f in features)}) AS __x",
            f"explode(sequence(0, {pairs - 1})) AS __pair",
        )
        .selectExpr("*", f"pmod(xxhash64({seeded}), {size}L) AS __b")
        .join(pool, "__b")
        .repartition(*keys)
    )
    steps = (
        drawn.selectExpr(
            "*",
            f"transform(array_sort(transform(sequence(0, {k - 1}),"
            f" j -> struct(xxhash64({seeded}, j) AS h, j AS j))), s -> s.j) AS __order",
        )
        .selectExpr(*qs(keys), "__pair", "__x", "__ref", "explode(array(__order, reverse(__order))) AS __order")
        .selectExpr("*", f"explode(sequence(0, {k})) AS __t")
        .selectExpr(
            *qs(keys),
            "__pair",
            "CASE WHEN __t > 0 THEN __order[__t - 1] END AS __into",
            f"CASE WHEN __t < {k} THEN __order[__t] END AS __from",
            f"transform(sequence(0, {k - 1}), j -> CASE WHEN array_position(__order, j) <= __t"
            " THEN __x[j] ELSE __ref[j] END) AS __mixed",
        )
    )
    scored = (
        model.model.transform(steps.withColumn(VECTOR, array_to_vector("__mixed")))
        .select(*keys, "__pair", "__into", "__from", "__mixed", vector_to_array("__probability").alias("__p"))
        .selectExpr(*qs(keys), "__pair", "__into", "__from", "__mixed", f"{outputs[output]} AS __f")
    )
    # the step that switches a feature on gains f, the step before lost it; where all are on, the vector is the row
    per_pair = scored.groupBy(*keys, "__pair").agg(
        F.expr("max(CASE WHEN __from IS NULL THEN __mixed END) AS __x"),
        *[
            F.expr(f"sum(CASE {j} WHEN __into THEN __f WHEN __from THEN -__f ELSE 0D END) / 2 AS __d{j}")
            for j in range(k)
        ],
    )
    per_row = per_pair.groupBy(*keys).agg(
        F.expr("max(__x) AS __x"),
        *[F.expr(f"avg(__d{j}) AS __m{j}") for j in range(k)],
        *[F.expr(f"stddev_samp(__d{j}) / sqrt({pairs}D) AS __s{j}") for j in range(k)],
    )
    cells = ", ".join(
        f"struct({text(f)} AS feature, __x[{j}] AS value, __m{j} AS phi, __s{j} AS se)" for j, f in enumerate(features)
    )
    return per_row.selectExpr(*qs(keys), f"inline(array({cells}))")


def mean_with_error(phi: DataFrame) -> DataFrame:
    """Per feature: mean attribution and its standard error, from sampled values.

    Rows draw their background independently, so the squared errors add up.
    """
    return phi.groupBy("feature").agg(
        F.expr("avg(phi) AS mean_phi"),
        F.expr("sqrt(sum(se * se)) / count(1) AS se"),
        F.expr("count(1) AS n"),
    )


# --- summaries ---------------------------------------------------------------


def importance(phi: DataFrame) -> DataFrame:
    """Mean absolute and mean attribution per feature, and the correlation of the
    attribution with the feature's value."""
    return phi.groupBy("feature").agg(
        F.expr("avg(abs(phi)) AS mean_abs"),
        F.expr("avg(phi) AS mean_phi"),
        F.expr(
            "try_divide(covar_pop(value, phi), stddev_pop(value) * stddev_pop(phi)) AS corr"
        ),
        F.expr("count(1) AS n"),
    )


def summarise(phi: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    """``importance`` as a mapping in feature order (one entry per feature)."""
    rows = {r["feature"]: r.asDict() for r in importance(phi).collect()}
    empty = {"mean_abs": 0.0, "mean_phi": 0.0, "corr": None, "n": 0}
    return {f: rows.get(f, empty) for f in features}


def top_features(summary: Mapping[str, Mapping], k: int, among: Sequence[str] | None = None) -> list[str]:
    """The ``k`` features with the largest mean absolute attribution, earlier
    features first on a tie."""
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    names = [f for f in summary if among is None or f in among]
    return sorted(names, key=lambda f: -summary[f]["mean_abs"])[:k]


def direction_of(summary: Mapping[str, Mapping], feature: str, by: str = "corr") -> str:
    """``high`` when larger values push towards class 1. ``by='mean_phi'`` takes the
    sign of the mean attribution instead of the correlation's."""
    if by not in ("corr", "mean_phi"):
        raise ValueError(f"direction must come from 'corr' or 'mean_phi', not {by!r}")
    value = summary[feature][by]
    if by == "corr" and (value is None or np.isnan(value)):
        value = summary[feature]["mean_phi"]
    return "high" if value > 0 else "low"


def model_info(model: Fitted, df: DataFrame) -> dict:
    """Kind, features and base value of a model."""
    info = {"kind": model.kind, "features": list(model.features)}
    if model.kind == "logistic_regression":
        means = df.selectExpr(
            *[f"avg(CAST({q(f)} AS DOUBLE)) AS m{i}" for i, f in enumerate(model.features)]
        ).first()
        info["base_value"] = model.intercept + sum(
            w * means[f"m{i}"] for i, w in enumerate(model.weights.values())
        )
    else:
        nodes = node_table(model, df.sparkSession)
        info["base_value"] = sum(
            tree_base(leaf_table(model, nodes.where(F.col("tree").isin(trees)))) for trees in tree_passes(nodes)
        )
    return info
