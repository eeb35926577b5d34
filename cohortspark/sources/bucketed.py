"""Tables bucketed by subject or encounter, so that joins and groupings on it move nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import q, qs
from ..session import null_safe, require_columns, settle, shared_folder


@dataclass(frozen=True)
class Bucketed:
    """A table in two parts that share no key.

    ``even`` is bucketed and sorted by ``keys``; ``hot`` holds the keys that are too large for a
    bucket, in plain files that any number of tasks may read (None if there are none).
    """

    name: str
    keys: tuple[str, ...]
    buckets: int
    even: DataFrame
    hot: DataFrame | None

    def apply(self, plan: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        """``plan(part, colocated)`` on both parts, united.

        Right for every plan whose result rows each depend on the rows of one key. The second
        argument tells whether rows of a key lie together already.
        """
        done = plan(self.even, True)
        return done if self.hot is None else done.unionByName(plan(self.hot, False))

    def rows(self) -> DataFrame:
        """The whole table."""
        return self.apply(lambda part, _: part)


def save_bucketed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    buckets: int | None = None,
    folder: str | None = None,
    split_hot: bool = True,
) -> Bucketed:
    """Write ``df`` as catalog tables ``name`` and ``name_hot`` below ``folder`` and open them.

    Every bucket is one sorted file. A key with more rows than an average bucket goes to the hot
    part, so at most ``buckets`` keys do. ``split_hot=False`` keeps all rows in the
    buckets, for tables with one row a key. Both tables are replaced if they exist; ``df`` must
    not read from them. Null keys are a key. The default number of buckets is that of shuffle
    partitions; tables joined with each other need the same one.
    """
    keys = list(keys)
    require_columns(df, keys, "table to bucket")
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = (folder or shared_folder(spark)).rstrip("/")
    even, hot_name = df, f"{name}_hot"
    spark.sql(f"DROP TABLE IF EXISTS {q(hot_name)}")
    if split_hot:
        most = df.count() / buckets
        large, _ = settle(df.groupBy(*keys).count().where(f"count > {most!r}D").select(*keys))
        if not large.isEmpty():
            marked = null_safe(df, large.withColumn("__hot", F.lit(True)), keys, "left")
            even = marked.where("__hot IS NULL").drop("__hot")
            _write(marked.where("__hot").drop("__hot").write, hot_name, folder)
    _write(even.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys), name, folder)
    return open_bucketed(spark, name, keys, buckets)


def _write(writer, name: str, folder: str) -> None:
    writer.mode("overwrite").format("parquet").option("path", f"{folder}/{name}").saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, keys: Sequence[str], buckets: int) -> Bucketed:
    """A table that ``save_bucketed`` wrote; another key or number of buckets raises ``ValueError``."""
    details = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {q(name)}").collect()}
    stored = (details.get("Num Buckets"), details.get("Bucket Columns"))
    asked = (str(buckets), f"[{', '.join(qs(keys))}]")
    if stored != asked:
        raise ValueError(f"table {name!r} is bucketed as {stored}, not as {asked}")
    hot = spark.table(f"{name}_hot") if spark.catalog.tableExists(f"{name}_hot") else None
    return Bucketed(name, tuple(keys), buckets, spark.table(name), hot)
