"""Tables bucketed by subject or encounter: same results, nothing moved, hot keys apart."""

import datetime as dt

import pytest

from cohortspark.operators.panel import add_hours, anchored_features, feature_frame
from cohortspark.plans.registry import rounded
from cohortspark.sources.bucketed import open_bucketed, save_bucketed

from helpers import lcg, plan, table

START = dt.datetime(2020, 1, 1)
SCHEMA = "subject_id bigint, itemid int, charttime timestamp, valuenum double"


@pytest.fixture(scope="module")
def observations(spark):
    # subject 7 has a third of the rows, some have no subject
    people = [7] * 200 + [100 + i % 90 for i in range(390)] + [None] * 10
    rows = [
        (s, 1 + i % 2, START + dt.timedelta(days=int(60 * v)), v)
        for i, (s, v) in enumerate(zip(people, lcg(600, 8)))
    ]
    return table(spark, rows, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return table(spark, [(1, "a"), (2, "b")], "itemid int, feature string")


def rows(df):
    return sorted(map(repr, rounded(df.select(sorted(df.columns))).collect()))


def test_lookback_of_a_bucketed_table(spark, observations, items, tmp_path):
    stored = save_bucketed(observations, "bucketed_obs", ["subject_id"], 6, str(tmp_path))
    assert [r[0] for r in stored.hot.select("subject_id").distinct().collect()] == [7]
    assert rows(stored.rows()) == rows(observations)
    got = stored.apply(lambda part, together: feature_frame(part, items, ["a", "b"], 30, colocated=together))
    assert rows(got) == rows(feature_frame(observations, items, ["a", "b"], 30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(feature_frame(stored.even, items.hint("broadcast"), ["a", "b"], 30, colocated=True))
        apart = plan(feature_frame(stored.even, items.hint("broadcast"), ["a", "b"], 30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "hashpartitioning" not in text
    assert "hashpartitioning" in apart


def test_anchors_of_a_bucketed_table(spark, observations, tmp_path):
    people = table(spark, [(i, START) for i in [7, *range(100, 180)]], "subject_id bigint, admittime timestamp")
    stored = save_bucketed(observations, "bucketed_anchored", ["subject_id"], 6, str(tmp_path))
    anchors = save_bucketed(people, "bucketed_anchors", ["subject_id"], 6, str(tmp_path), split_hot=False)
    assert anchors.hot is None
    named = observations.selectExpr("*", "CASE itemid WHEN 1 THEN 'a' ELSE 'b' END AS feature")

    def features(part, anchors, together):
        part = part.selectExpr("*", "CASE itemid WHEN 1 THEN 'a' ELSE 'b' END AS feature")
        return anchored_features(part, anchors, None, ["a", "b"], "subject_id", hours=(0, 480), colocated=together)

    got = stored.apply(lambda part, together: features(part, anchors.even, together))
    assert rows(got) == rows(anchored_features(named, people, None, ["a", "b"], "subject_id", hours=(0, 480)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(add_hours(stored.even, anchors.even, "subject_id", "charttime", "admittime", True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "hashpartitioning" not in text


def test_bucketed_tables_are_checked_when_opened(spark, observations, tmp_path):
    cool = observations.where("subject_id IS DISTINCT FROM 7")
    save_bucketed(observations, "bucketed_twice", ["subject_id"], 4, str(tmp_path))
    stored = save_bucketed(cool, "bucketed_twice", ["subject_id"], 4, str(tmp_path / "again"))
    assert stored.hot is None and rows(stored.rows()) == rows(cool)
    assert rows(open_bucketed(spark, "bucketed_twice", ["subject_id"], 4).rows()) == rows(cool)
    with pytest.raises(ValueError, match="bucketed"):
        open_bucketed(spark, "bucketed_twice", ["itemid"], 4)
    with pytest.raises(ValueError, match="bucketed"):
        open_bucketed(spark, "bucketed_twice", ["subject_id"], 5)
    empty = save_bucketed(observations.limit(0), "bucketed_empty", ["subject_id"], 4, str(tmp_path))
    assert empty.hot is None and empty.rows().count() == 0
