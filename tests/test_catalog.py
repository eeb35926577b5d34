"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_points

DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="sample tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _sorted(rows):
    clean = [tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, DIR)
    result = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in result.description}
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == kinds
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert _sorted(got) == _sorted(result.fetchall())


@pytest.mark.parametrize(
    "name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql()))
)
def test_runs(spark, name):
    assert entry_points.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
