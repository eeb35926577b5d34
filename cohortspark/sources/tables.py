"""Reading the star schema: lazily, by name, with the filter at the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table, require_columns

# Columns the operators need from each table; further columns pass through.
REQUIRED = {
    "admissions": ["subject_id"],
    "diagnoses_icd": ["subject_id", "icd_code", "icd_version"],
    "patients": ["subject_id"],
    "labevents": ["subject_id", "itemid", "charttime", "valuenum"],
}
EXPECTED = [
    "patients",
    "admissions",
    "icustays",
    "diagnoses_icd",
    "d_icd_diagnoses",
    "labevents",
    "d_labitems",
]
# Item lists up to this length are pushed to the scan as an IN filter.
IN_LIST = 1_000


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in fs.globStatus(path) or []]


def table_path(spark: SparkSession, root: str, name: str) -> str:
    """``root/name`` when it holds parquet files, else ``root/name.parquet``."""
    folder, single = f"{root}/{name}", f"{root}/{name}.parquet"
    if _matches(spark, f"{folder}/*.parquet"):
        return folder
    if _matches(spark, single):
        return single
    raise FileNotFoundError(f"table {name}: neither {folder}/*.parquet nor {single} exists")


def read_table(
    spark: SparkSession, root: str, name: str, required: Sequence[str] | None = None
) -> DataFrame:
    df = spark.read.parquet(table_path(spark, root, name))
    require_columns(df, REQUIRED.get(name, []) if required is None else required, f"table {name}")
    return df


def only_items(df: DataFrame, items: Sequence, column: str = "itemid") -> DataFrame:
    """Rows of the named items: an IN filter at the scan, or a semi-join with the
    list when it is long."""
    items = list(items)
    if len(items) <= IN_LIST:
        return df.where(F.col(column).isin(items))
    kind = df.schema[column].dataType.simpleString()
    listed = local_table(df.sparkSession, [(i,) for i in items], f"{column} {kind}")
    return df.join(listed.distinct(), column, "left_semi")


def inventory(spark: SparkSession, root: str, names: Sequence[str] = tuple(EXPECTED)) -> DataFrame:
    """Rows, files and bytes per table; absent tables have zero of each."""
    parts = []
    for name in names:
        try:
            path = table_path(spark, root, name)
        except FileNotFoundError:
            continue
        parts.append(
            spark.read.parquet(path)
            .selectExpr(f"'{name}' AS table", "_metadata.file_path AS f", "_metadata.file_size AS s")
            .groupBy("table", "f", "s")
            .agg(F.expr("count(1) AS n"))
        )
    listed = local_table(spark, [(n,) for n in names], "table string")
    if not parts:
        return listed.selectExpr("table", "0L AS rows", "0L AS files", "0L AS bytes")
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    found = files.groupBy("table").agg(
        F.expr("sum(n) AS rows"), F.expr("count(1) AS files"), F.expr("sum(s) AS bytes")
    )
    return listed.join(found, "table", "left").na.fill(0)


class Tables:
    """Named readers over one folder.

    ``names`` maps the roles (admissions, diagnoses, patients, labs) to table
    names. Reads are lazy; ``cached`` persists a table until ``clear``.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        items: Sequence = (),
        names: Mapping[str, str] | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.items = list(items)
        self.names = {
            "admissions": "admissions",
            "diagnoses": "diagnoses_icd",
            "patients": "patients",
            "labs": "labevents",
            **(names or {}),
        }
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str, required: Sequence[str] | None = None) -> DataFrame:
        return read_table(self.spark, self.root, name, required)

    def admissions(self) -> DataFrame:
        return self.table(self.names["admissions"])

    def diagnoses(self) -> DataFrame:
        return self.table(self.names["diagnoses"])

    def patients(self) -> DataFrame:
        return self.table(self.names["patients"])

    def lab_results(self) -> DataFrame:
        """The fact table, reduced to the configured items at the scan."""
        labs = self.table(self.names["labs"])
        return only_items(labs, self.items) if self.items else labs

    def inventory(self) -> DataFrame:
        return inventory(self.spark, self.root)

    def cached(self, name: str) -> DataFrame:
        """A table or reader result kept by Spark for repeated use."""
        if name not in self._kept:
            reader = getattr(self, name, None)
            df = reader() if callable(reader) else self.table(name)
            self._kept[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    def clear(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
