"""Imputing, scaling, outliers, splits and folds."""

import datetime as dt

import pytest

from cohortspark.operators.prepare import Imputer, Scaler, remove_outliers
from cohortspark.operators.split import (
    Splitter,
    class_distribution,
    folds,
    parts,
    split_stats,
    split_summary,
    train_test,
)
from cohortspark.sources import load_splits, save_splits

from helpers import column, plan, table

WIDE = "subject_id bigint, hemoglobin double, wbc double"


@pytest.fixture
def gaps(spark):
    rows = [(1, 12.0, 5.0), (2, 13.0, None), (3, None, 7.0), (4, 14.0, 8.0), (5, 15.0, 9.0)]
    return table(spark, rows, WIDE)


def test_median_and_mean(gaps):
    filled = {r["subject_id"]: r for r in Imputer("median").fit_transform(gaps).collect()}
    assert (filled[3]["hemoglobin"], filled[2]["wbc"], filled[1]["wbc"]) == (13.5, 7.5, 5.0)
    assert Imputer("mean").fit(gaps).fill == {"hemoglobin": 13.5, "wbc": 7.25}
    assert Imputer("median", approx=True).fit(gaps).fill["wbc"] == 7.0


def test_drop_zero_invalid(gaps):
    assert sorted(column(Imputer("drop").transform(gaps), "subject_id")) == [1, 4, 5]
    assert 0.0 in column(Imputer("zero").transform(gaps), "wbc")
    with pytest.raises(ValueError, match="strategy"):
        Imputer("guess")
    with pytest.raises(RuntimeError):
        Imputer("median").transform(gaps)


def test_fitted_values_are_reused(spark, gaps):
    fitted = Imputer("median").fit(gaps)
    other = table(spark, [(9, None, 1.0)], WIDE)
    assert fitted.transform(other).first()["hemoglobin"] == 13.5


def test_all_null_column_stays_null(spark):
    df = table(spark, [(1, None, 1.0), (2, None, None)], WIDE)
    out = Imputer("median").fit_transform(df)
    assert column(out, "hemoglobin") == [None, None] and column(out, "wbc") == [1.0, 1.0]
    assert Imputer("drop").transform(df).count() == 0


def test_nan_is_missing_and_empty_stays_empty(spark):
    df = table(spark, [(1, float("nan"), 1.0), (2, 4.0, 2.0)], WIDE)
    assert column(Imputer("median").fit_transform(df), "hemoglobin") == [4.0, 4.0]
    empty = df.where("subject_id > 9")
    assert Scaler().fit_transform(Imputer("mean").fit_transform(empty)).count() == 0


def test_scaling(spark):
    df = table(spark, [(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 5.0, 5.0)], WIDE)
    out = Scaler("standard").fit_transform(df)
    assert out.columns == df.columns
    assert column(out, "hemoglobin") == pytest.approx([-1.224744871, 0, 1.224744871])
    assert column(out, "wbc") == [0.0, 0.0, 0.0]
    assert column(Scaler("minmax").fit_transform(df), "hemoglobin") == [0.0, 0.5, 1.0]
    with pytest.raises(RuntimeError):
        Scaler().transform(df)
    with pytest.raises(ValueError):
        Scaler("robust")
    ids = df.select("subject_id")
    assert Scaler().fit_transform(ids).columns == ["subject_id"]
    fitted = Scaler("minmax").fit(df)
    assert fitted.transform(table(spark, [(9, 7.0, 5.0)], WIDE)).first()["hemoglobin"] == 1.5
    assert fitted.params_table(df).count() == 2


def test_outliers_removed(spark):
    df = table(spark, [(i, float(i), 0.0) for i in range(20)] + [(99, 500.0, 0.0), (100, None, 0.0)], WIDE)
    assert set(column(df, "subject_id")) - set(column(remove_outliers(df, ["hemoglobin"]), "subject_id")) == {99}
    assert remove_outliers(df, ["hemoglobin"], "zscore", 3).where("subject_id = 99").count() == 0
    with pytest.raises(ValueError):
        remove_outliers(df, ["hemoglobin"], "magic")


@pytest.fixture
def hundred(spark):
    start = dt.date(2023, 1, 1)
    rows = [
        (1000 + i, 1 if i < 30 else 0, str(start + dt.timedelta(days=i)), 5 + 0.1 * i)
        for i in range(100)
    ]
    return table(spark, rows, "subject_id bigint, label int, admission_date string, wbc double")


@pytest.mark.parametrize("sizes", [(0, 0.1), (1, 0.1), (-0.1, 0.1), (0.2, 1), (0.5, 0.5), (0.6, 0.5)])
def test_bad_sizes(sizes):
    with pytest.raises(ValueError):
        Splitter(*sizes)


def test_random_split(hundred):
    marked = Splitter().random(hundred, ["subject_id"])
    ids = [set(column(p, "subject_id")) for p in parts(marked)]
    assert [len(i) for i in ids] == [70, 10, 20]
    assert not (ids[0] & ids[1] or ids[0] & ids[2] or ids[1] & ids[2])
    again = parts(Splitter().random(hundred, ["subject_id"]))[0]
    assert set(column(again, "subject_id")) == ids[0]
    other = parts(Splitter().random(hundred, ["subject_id"], seed=1))[0]
    assert set(column(other, "subject_id")) != ids[0]
    assert "Exchange" not in plan(marked)


def test_one_cut_formula_for_all_strategies(hundred):
    thirty = hundred.limit(30)
    splitter = Splitter(0.1, 0.2)
    for marked in (
        splitter.random(thirty, ["subject_id"]),
        splitter.temporal(thirty, "admission_date", ["subject_id"]),
    ):
        assert [p.count() for p in parts(marked)] == [21, 6, 3]


def test_temporal_split(hundred):
    train, val, test = parts(Splitter().temporal(hundred, "admission_date", ["subject_id"]))
    assert [p.count() for p in (train, val, test)] == [70, 10, 20]
    assert max(column(train, "admission_date")) < min(column(val, "admission_date"))
    assert max(column(val, "admission_date")) < min(column(test, "admission_date"))
    with pytest.raises(ValueError, match="nope"):
        Splitter().temporal(hundred, "nope", ["subject_id"])


def test_temporal_split_with_one_hot_instant(spark):
    same = dt.datetime(2024, 1, 1)
    rows = [(i, same) for i in range(60)] + [(100 + i, same + dt.timedelta(seconds=i + 1)) for i in range(40)]
    df = table(spark, rows, "k bigint, t timestamp_ntz")
    sizes = [p.count() for p in parts(Splitter(0.5, 0.25).temporal(df, "t", ["k"]))]
    assert sizes == [25, 25, 50]


def test_stratified_split(spark, hundred):
    marked = Splitter().stratified(hundred, "label", ["subject_id"])
    for part in parts(marked):
        share = sum(column(part, "label")) / part.count()
        assert abs(share - 0.3) <= 0.05
    gaps = hundred.selectExpr("subject_id", "CASE WHEN label = 1 THEN 1 END AS label")
    assert Splitter().stratified(gaps, "label", ["subject_id"]).count() == 30
    train, test = train_test(hundred, ["subject_id"], 0.3, "label")
    assert (train.count(), test.count()) == (70, 30)


def test_folds(hundred):
    placed = folds(hundred, 4, ["subject_id"])
    counts = {(r["label"], r["fold"]): r["count"] for r in placed.groupBy("label", "fold").count().collect()}
    assert len(counts) == 8
    for label, n in ((1, 30), (0, 70)):
        assert all(n // 4 <= counts[(label, f)] <= n // 4 + 1 for f in range(4))
    with pytest.raises(ValueError):
        folds(hundred, 1, ["subject_id"])


def test_statistics_and_storage(spark, hundred, tmp_path):
    marked = Splitter().temporal(hundred, "admission_date", ["subject_id"])
    stats = split_stats(marked, "temporal", "label", "admission_date")
    rows = {(r["split"], r["class"]): r for r in stats.collect()}
    assert rows[("train", "1")]["class_pct"] == 42.86 and rows[("test", "0")]["n"] == 20
    assert rows[("train", "0")]["t_end"] < rows[("val", "0")]["t_start"]
    assert "train: 70 rows (70.0 %)" in split_summary(stats)
    paths = save_splits(marked, stats, "ra", str(tmp_path))
    assert set(paths) == {"train", "val", "test", "stats"}
    train, val, test, loaded = load_splits(spark, "ra", str(tmp_path))
    assert (train.count(), val.count(), test.count(), loaded.count()) == (70, 10, 20, 4)
    assert "split" not in train.columns
    with pytest.raises(FileNotFoundError):
        load_splits(spark, "absent", str(tmp_path))
    assert class_distribution(hundred.where("false"), "label").count() == 0
    assert {r["class"]: r["pct"] for r in class_distribution(hundred, "label").collect()} == {0: 70.0, 1: 30.0}
