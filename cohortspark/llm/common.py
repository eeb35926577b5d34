"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import require_columns, stage

__all__ = ["WORD", "by_value", "documents", "in_fold", "inputs", "spare", "stage", "tidy"]

# A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship the functions of ``module`` with a job, so executors need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has this remainder; false for a null id."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(fold == F.lit(remainder), F.lit(False))


def inputs(df: DataFrame, what: str, **columns: str) -> DataFrame:
    """Only the named columns, under their role names; others never take part."""
    require_columns(df, columns.values(), what)
    return df.select(*[df[name].alias(role) for role, name in columns.items()])


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep clear of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def tidy(run):
    """``run`` for mapInArrow, after which the Python worker hands its freed memory back.

    Workers live on between tasks and stages, and what a model or a cache took would stay with them.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
