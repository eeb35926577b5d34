"""Writing extracts, splits, reports and results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import starts_with_any
from .config import Config
from .tables import _matches, only_items, read_table

SPLITS = ("train", "val", "test")


def code_filter(config: Config, code: str = "icd_code", dots: bool = False) -> Column:
    """Codes that begin with any rule's prefix, as ``match_codes`` would match them.

    Dots count on neither side, so a code stored with its dot stays; ``dots=True`` compares as
    written. No rules keep no codes. First characters reach the scan.
    """
    return starts_with_any(code, [r.prefix for r in config.code_rules()], normalize=not dots)


def extract_tables(
    spark: SparkSession,
    source: str,
    target: str,
    config: Config,
    tables: Sequence[str] = (
        "labevents",
        "diagnoses_icd",
        "admissions",
        "patients",
        "d_labitems",
        "d_icd_diagnoses",
        "icustays",
    ),
    filtered: bool = True,
    dots: bool = False,
) -> dict[str, str]:
    """Copy the tables as snappy parquet, reducing labs to the configured items
    and diagnoses to the configured codes unless ``filtered`` is off."""
    written = {}
    for name in tables:
        df = read_table(spark, source, name)
        if filtered and name == "labevents":
            df = only_items(df, config.item_ids())
        elif filtered and name == "diagnoses_icd":
            df = df.where(code_filter(config, dots=dots))
        path = f"{target.rstrip('/')}/{name}"
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
        written[name] = path
    return written


def save_splits(df: DataFrame, stats: DataFrame | None, name: str, folder: str) -> dict[str, str]:
    """One partitioned write for the three parts, plus their statistics as JSON."""
    base = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").partitionBy("split").parquet(base)
    paths = {s: f"{base}/split={s}" for s in SPLITS}
    if stats is not None:
        paths["stats"] = f"{base}_split_stats"
        stats.repartition(1).write.mode("overwrite").json(paths["stats"])
    return paths


def load_splits(
    spark: SparkSession, name: str, folder: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(train, val, test, statistics or None); every part must be present."""
    base = f"{folder.rstrip('/')}/{name}"
    missing = [s for s in SPLITS if not _matches(spark, f"{base}/split={s}")]
    if missing:
        raise FileNotFoundError(f"split(s) {missing} of {name} not found under {base}")
    whole = spark.read.parquet(base)
    stats = f"{base}_split_stats"
    return (
        *[whole.where(F.col("split") == s).drop("split") for s in SPLITS],
        spark.read.json(stats) if _matches(spark, stats) else None,
    )


def write_report(df: DataFrame, path: str) -> str:
    """A report table (one row per cohort, feature or method) as one CSV file."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_result(metrics: DataFrame, predictions: DataFrame | None, path: str, info: dict) -> dict:
    """Metrics and run facts as JSON lines; predictions stay a parquet table."""
    text = json.dumps(info, sort_keys=True, default=str)
    metrics.withColumn("run", F.lit(text)).repartition(1).write.mode("overwrite").json(f"{path}/metrics")
    out = {"metrics": f"{path}/metrics"}
    if predictions is not None:
        predictions.write.mode("overwrite").parquet(f"{path}/predictions")
        out["predictions"] = f"{path}/predictions"
    return out
