"""Tree attribution of many rows: looked up by the outcomes of the tests, in large blocks."""

import numpy as np
import pytest

from cohortspark.operators import attribution
from cohortspark.operators.attribution import attribute, explain_batch, leaf_table, node_table, tree_base
from cohortspark.operators.models import fit_model
from cohortspark.operators.thresholds import AttributionLiteratureRule

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    x = np.random.default_rng(5).normal(0, 1, (400, 4))
    rows = [(i, *map(float, v), int(v[0] + v[1] * v[2] > 0)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, label int").coalesce(1).cache()


@pytest.fixture(scope="module", params=["random_forest", "boosted_trees"])
def fitted(request, spark, frame):
    model = fit_model(frame, NAMES, kind=request.param, settings={"trees": 5, "depth": 7})
    return model, leaf_table(model, node_table(model, spark))


def by_row(x, leaves):
    return sum(attribution._row_values(x, *tree) for tree in leaves)


def test_tables_give_the_values_of_single_rows(fitted, monkeypatch):
    _, leaves = fitted
    x = np.random.default_rng(6).normal(0, 1, (3_000, 4))
    cuts = np.unique([lo for tree in leaves for lo in tree[1].ravel() if np.isfinite(lo)])[:400]
    x[: len(cuts)] = cuts[:, None]  # rows exactly on the cuts
    want = by_row(x, leaves)
    for rows in (0, 1, 7, 60, 500, 3_000):
        assert explain_batch(x[:rows], leaves) == pytest.approx(want[:rows], abs=1e-12)
    for most in (1, 5, 10):
        monkeypatch.setattr(attribution, "UNIT_TESTS", most)
        assert explain_batch(x, leaves) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(attribution, "LOOKUP_ROWS", 999)
    assert explain_batch(x, leaves) == pytest.approx(want, abs=1e-12)


def test_work_for_a_leaf_does_not_grow_with_the_rows(fitted, monkeypatch):
    _, leaves = fitted
    worked = []
    pattern_values = attribution._pattern_values

    def counted(share, value):
        worked.append(len(value))
        return pattern_values(share, value)

    monkeypatch.setattr(attribution, "_pattern_values", counted)
    monkeypatch.setattr(attribution, "_row_values", lambda *_: pytest.fail("leaves were worked out row by row"))
    x = np.random.default_rng(7).normal(0, 1, (100_000, 4))
    explain_batch(x, leaves)
    assert sum(worked) == sum(len(tree[0]) for tree in leaves)


def test_a_tree_of_one_leaf_explains_nothing():
    stump = (np.zeros((1, 0), np.int32), *[np.zeros((1, 0))] * 3, np.array([0.25]))
    assert explain_batch(np.ones((9, 2)), [stump]).tolist() == [[0.0, 0.0]] * 9
    assert tree_base([stump]) == 0.25


def test_batches_are_explained_together(spark, frame, fitted, monkeypatch):
    model, leaves = fitted
    x = np.array([[r[f] for f in NAMES] for r in frame.orderBy("k").collect()])
    monkeypatch.setattr(attribution, "BLOCK_CELLS", 4 * 90)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        phi = {(r["k"], r["feature"]): r["phi"] for r in attribute(model, frame, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = by_row(x, leaves)
    assert len(phi) == 1_600
    for j, f in enumerate(NAMES):
        assert [phi[i, f] for i in range(400)] == pytest.approx(want[:, j], abs=1e-12)


def test_rule_finders_spread_the_rows(frame, monkeypatch):
    seen = []
    tree_attribution = attribution.tree_attribution

    def watched(model, df, keys, **options):
        seen.append(options)
        return tree_attribution(model, df, keys, **options)

    monkeypatch.setattr(attribution, "tree_attribution", watched)
    limits = {f: {"low": 0.0, "high": 0.0} for f in NAMES}
    rule = AttributionLiteratureRule(limits, keys=["k"], settings={"trees": 4, "depth": 3}).fit(frame, NAMES)
    assert rule.feature == "a" and seen == [{"partitions": frame.sparkSession.sparkContext.defaultParallelism}]
    AttributionLiteratureRule(limits, model="logistic_regression", keys=["k"]).fit(frame, NAMES)
