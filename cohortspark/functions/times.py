"""Timestamps given as timestamp, date or string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import require_columns

MICROS_PER_HOUR = 3_600_000_000


def as_timestamp(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` as a timestamp; text that is not a time fails the job."""
    require_columns(df, [name])
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(kind, T.DateType):
        return df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    if isinstance(kind, T.StringType):
        parsed = F.expr(f"try_cast(`{name}` AS timestamp_ntz)")
        message = F.concat(F.lit(f"column {name} is not a time: "), F.col(name))
        return df.withColumn(
            name,
            F.when(F.col(name).isNull(), F.lit(None).cast("timestamp_ntz"))
            .when(parsed.isNull(), F.raise_error(message).cast("timestamp_ntz"))
            .otherwise(parsed),
        )
    raise ValueError(f"column {name} of type {kind.simpleString()} is not a time")


def epoch_micros(df: DataFrame, name: str) -> str:
    """SQL text: microseconds since 1970 as a long, in the order of the column.

    A timestamp without zone is read as wall-clock time, whatever the session zone.
    """
    kind = df.schema[name].dataType
    c = f"`{name}`"
    if isinstance(kind, T.TimestampType):
        return f"unix_micros({c})"
    if isinstance(kind, T.TimestampNTZType):
        return (
            f"(CAST(datediff(CAST({c} AS DATE), DATE'1970-01-01') AS BIGINT) * 86400000000"
            f" + hour({c}) * 3600000000L + minute({c}) * 60000000L"
            f" + CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT))"
        )
    raise ValueError(f"column {name} of type {kind.simpleString()} is not a timestamp")


def hours_between(df: DataFrame, start: str, end: str) -> Column:
    """Hours from ``start`` to ``end`` as a double."""
    span = f"({epoch_micros(df, end)} - {epoch_micros(df, start)})"
    return F.expr(f"{span} / {float(MICROS_PER_HOUR)!r}D")


def within_hours(hours: Column, low: float, high: float) -> Column:
    """Inclusive band of hours around an anchor."""
    return hours.between(F.lit(float(low)), F.lit(float(high)))
