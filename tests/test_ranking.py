"""Order statistics against plain Python, on skewed and awkward inputs."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortspark.operators import profile, ranking
from cohortspark.operators.ranking import cuts_passed, hash_order, quantiles, running_sums, unpivot

from helpers import lcg, plan, table


def test_quantiles_match_numpy_by_group(spark):
    # a third of all rows are one value of one group
    rows = [("a", 7.0)] * 400 + [("a", v * 10) for v in lcg(300, 3)] + [("b", v) for v in lcg(501, 4)]
    df = table(spark, rows, "g string, v double")
    found = {r["g"]: r for r in quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.93}, ["g"]).collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.93)):
            assert found[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert found[g]["n"] == len(values)


def test_quantiles_skip_null_and_nan_and_empty(spark):
    df = table(spark, [(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = quantiles(df, "v", {"m": 0.5}).first()
    assert (row["m"], row["n"]) == (2.0, 2)
    empty = quantiles(df.where("v > 100 AND NOT isnan(v)"), "v", {"m": 0.5}).collect()
    assert [r for r in empty if r["m"] is not None] == []


def test_quantiles_null_group_is_a_group(spark):
    df = table(spark, [(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    found = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert found == {None: 1.5, "a": 5.0}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_refine_ranges(spark, monkeypatch, by):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 3)
    rows = [("a", v) for v in lcg(3000, 3)] + [("b", 0.25)] * 2000 + [("b", v) for v in lcg(1000, 4)]
    df = table(spark, rows, "g string, v double")
    found = quantiles(df, "v", {"a": 0.07, "m": 0.5}, by).collect()
    for r in found:
        values = [v for k, v in rows if not by or k == r["g"]]
        assert r["m"] == pytest.approx(np.quantile(values, 0.5), abs=1e-12)
        assert r["a"] == pytest.approx(np.quantile(values, 0.07), abs=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_by_narrow_brackets(spark, monkeypatch, by):
    monkeypatch.setattr(ranking, "WHOLE_ROWS", 0)
    rows = [("a", round(v, 3)) for v in lcg(9000, 5)] + [("b", 0.25)] * 4000 + [("b", v) for v in lcg(8000, 6)] + [(None, 1.0)] * 3
    df = table(spark, rows, "g string, v double")
    probs = {"lo": 0.0, "a": 0.07, "q": 0.25, "m": 0.5, "hi": 1.0}
    for r in quantiles(df, "v", probs, by, measures={"big": "max(v)", "total": "sum(v)"}).collect():
        values = [v for k, v in rows if not by or k == r["g"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert (r["n"], r["big"]) == (len(values), max(values)) and r["total"] == pytest.approx(sum(values))


def test_describe_scans_its_input_twice(spark, monkeypatch, tmp_path):
    path = f"{tmp_path}/described"
    table(spark, [("a", v) for v in lcg(50, 3)], "g string, v double").write.parquet(path)
    scans = []
    for name in ("stage", "settle"):
        real = getattr(ranking, name)

        def counting(df, *args, real=real):
            scans.append(plan(df).count("Location: InMemoryFileIndex") if path in plan(df) else 0)
            return real(df, *args)

        monkeypatch.setattr(ranking, name, counting)
    out = profile.describe(spark.read.parquet(path), "v", ["g"])
    assert sum(scans) == 2 and path not in plan(out)
    limits = table(spark, [("a", 0.2, 0.8)], "feature string, low double, high double")
    del scans[:]
    checked = profile.range_check(spark.read.parquet(path), limits, "v", "g")
    assert sum(scans) == 2 and path not in plan(checked)


def test_quantiles_approx(spark):
    df = table(spark, [(float(i),) for i in range(101)], "v double")
    assert quantiles(df, "v", {"m": 0.5}, approx=True).first()["m"] == 50.0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([-1.5, 0.0, 2.0, 2.5, 1e9]) | st.floats(-5, 5), min_size=1, max_size=60),
       st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = table(spark, [(float(v),) for v in values], "v double")
    assert quantiles(df, "v", {"q": p}).first()["q"] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [2, 16])
def test_running_sums(spark, descending, buckets):
    rows = [("a", round(v * 20), 1) for v in lcg(300, 5)] + [("a", 3, 2)] * 200 + [("b", 1, 4), (None, 2, 1)]
    df = table(spark, rows, "g string, v int, w int")
    found = running_sums(df, "v", {"w": "w"}, ["g"], descending, buckets).collect()
    assert len(found) == len({(g, v) for g, v, _ in rows})
    for r in found:
        own = [(v, w) for g, v, w in rows if g == r["g"]]
        ahead = [w for v, w in own if (v > r["v"] if descending else v < r["v"])]
        assert r["w_before"] == sum(ahead)
        assert r["w"] == sum(w for v, w in own if v == r["v"])
        assert r["w_total"] == sum(w for _, w in own)


def test_running_sums_plan_has_no_single_partition_over_rows(spark):
    df = table(spark, [("a", 1.0), ("b", 2.0)], "g string, v double")
    assert "SinglePartition" not in plan(running_sums(df, "v", {"n": "1L"}, ["g"]))


def _brute_cut(rows, key, ranks):
    ordered = sorted(rows, key=key)
    return [set(ordered[:k]) for k in ranks]


def test_cuts_are_exact_and_free_of_shuffles(spark):
    import hashlib

    n = 997
    df = table(spark, [(i,) for i in range(n)], "id bigint")
    out = cuts_passed(df, hash_order(["id"], 9), ["floor(n * 0.5D)", "floor(n * 0.9D)"])
    got = {r["id"]: r["passed"] for r in out.collect()}
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"9-{i}".encode()).hexdigest(), i))
    want = {i: (pos >= math.floor(n * 0.5)) + (pos >= math.floor(n * 0.9)) for pos, i in enumerate(order)}
    assert got == want
    assert "Exchange" not in plan(out)


def test_cuts_narrow_through_all_levels(spark, monkeypatch):
    # force every narrowing pass, as with very many rows
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 0)
    df = table(spark, [(i, i % 3) for i in range(200)], "id bigint, c int")
    out = cuts_passed(df, hash_order(["id"], 1), ["floor(n / 2)"], by=["c"])
    counts = {(r["c"], r["passed"]): r["count"] for r in out.groupBy("c", "passed").count().collect()}
    assert counts == {(0, 0): 33, (0, 1): 34, (1, 0): 33, (1, 1): 34, (2, 0): 33, (2, 1): 33}


def test_cut_table_beyond_the_small_limit_stays_distributed(spark, monkeypatch):
    import cohortspark.session as session

    monkeypatch.setattr(session, "SMALL_ROWS", 2)
    monkeypatch.setattr(session.settle, "__defaults__", (2,))
    df = table(spark, [(i, i % 50) for i in range(500)], "id bigint, c int")
    out = cuts_passed(df, hash_order(["id"], 1), ["floor(n * 0.3D + 1e-9D)"], by=["c"])
    assert out.where("passed = 0").count() == 150
    found = quantiles(df, "id", {"m": 0.5}, ["c"])
    assert {r["c"]: r["m"] for r in found.collect()} == {c: np.median(range(c, 500, 50)) for c in range(50)}


def test_rank_zero_and_full(spark):
    df = table(spark, [(i,) for i in range(5)], "id bigint")
    out = cuts_passed(df, hash_order(["id"], 1), ["0", "n"])
    assert {r["passed"] for r in out.collect()} == {1}


def test_unpivot(spark):
    df = table(spark, [(1, 2.0, None)], "id int, `it's` double, b double")
    rows = {(r["id"], r["feature"], r["value"]) for r in unpivot(df, ["it's", "b"], ["id"]).collect()}
    assert rows == {(1, "it's", 2.0), (1, "b", None)}
