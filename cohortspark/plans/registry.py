"""Names, Spark plans and SQL twins of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; its doubles are rounded as in the SQL twin."""

    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(plan(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        *[
            f"round(`{f.name}`, {DIGITS}) + 0D AS `{f.name}`"
            if f.dataType.simpleString() in ("double", "float")
            else f"`{f.name}`"
            for f in df.schema
        ]
    )


def r(expr: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    out = f"(round(CAST({expr} AS DOUBLE), {DIGITS}) + 0)"
    return f"{out} AS {name}" if name else out
