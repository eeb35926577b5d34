"""Session settings, shared storage, and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A table is handed to Spark as a local relation (and so may be broadcast) only
# when it has been counted on the driver and found to have at most this many rows.
SMALL_ROWS = 50_000

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "cohortspark",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, skew handling and a fixed time zone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder all executors share"
        )
    folder = tempfile.mkdtemp(prefix="cohortspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a frame is scanned several times: the written table cuts the
    lineage, keeps column pruning for each later scan and outlives executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType
) -> DataFrame:
    """A driver-made table as a local relation, so Catalyst knows its true size."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = [tuple(r) for r in rows]
    arrow = to_arrow_schema(schema)
    columns = [
        pa.array([r[i] for r in rows], type=field.type)
        for i, field in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def settle(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Compute ``df`` once: a local relation when it has at most ``limit`` rows, else
    a table in the shared folder.

    Returns the frame and whether it was small. Only the small form can be broadcast
    without further checks; joins with the large form are left to the optimizer.
    """
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return stage(df), False
    return df.sparkSession.createDataFrame(table, df.schema), True


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Equi-join that also matches null keys; keeps the left side's key columns."""
    if not keys:
        raise ValueError("null_safe needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    """Raise ``ValueError`` naming the columns ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; it has {df.columns}")
