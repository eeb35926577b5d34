"""The operators' roles (observations, facts, encounters, scores) on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.panel import Obs, feature_frame, lookback
from ..sources.config import Config
from ..sources.tables import read_table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
PANEL = Obs("user_id", "event_type", "ts", "value")
DIMENSIONS = 64

CONFIG = Config(
    cohorts={
        "ones": {"name": "ones", "codes": {"F": ["Brand#1"]}},
        "twos": {"name": "twos", "codes": {"O": ["Brand#2x"], "F": ["Brand#21"]}},
        "three": {"name": "three", "codes": {"F": ["Brand#3"]}},
        "five": {"name": "five", "codes": {"F": ["Brand#5"], "O": ["Brand#5"]}},
        "nobody": {"name": "nobody", "codes": {"F": ["Brand#99"]}},
    },
    features={
        "click": {"itemids": ["click"], "low": 5.0, "high": 90.0, "unit": "s"},
        "error": {"itemids": ["error"], "low": 10.0, "high": 80.0, "unit": "s"},
        "purchase": {"itemids": ["purchase"], "low": 2.0, "high": 120.0, "unit": "s"},
        "signup": {"itemids": ["signup"], "low": 8.0, "high": 100.0, "unit": "s"},
        "view": {"itemids": ["view"], "low": 1.0, "high": 60.0, "unit": "s"},
    },
    thresholds={"errors": {"click": {"low": 20.0, "high": 50.0}, "view": 45.0}},
)
COHORTS = sorted(CONFIG.cohorts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, [])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_items(spark: SparkSession) -> DataFrame:
    return CONFIG.item_map(spark)


def panel(spark: SparkSession, sf_dir: str, days: int | None = 2) -> DataFrame:
    """One row per user: statistics per event type over the last ``days``."""
    return feature_frame(events(spark, sf_dir), event_items(spark), EVENT_TYPES, days, PANEL)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, encounter, code, system, seq, value, time) from order lines."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(orders, lines.l_orderkey == orders.o_orderkey)
        .selectExpr(
            "o_custkey AS subject_id",
            "o_orderkey AS hadm_id",
            "p_brand AS icd_code",
            "l_linestatus AS icd_version",
            "l_linenumber AS seq_num",
            "l_quantity AS valuenum",
            "l_shipdate AS charttime",
            "p_brand AS feature",
        )
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS subject_id",
        "o_orderkey AS hadm_id",
        "o_orderdate AS admittime",
        "CAST(o_orderstatus = 'F' AS INT) AS hospital_expire_flag",
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS subject_id", "c_acctbal AS anchor_age", "c_mktsegment AS gender"
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line observations of an order, the return flag being the item."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS hadm_id",
        "l_returnflag AS feature",
        "l_shipdate AS charttime",
        "l_quantity AS valuenum",
    )


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderpriority AS grp",
        "o_totalprice AS score",
        "CAST(o_orderstatus = 'F' AS INT) AS label",
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "doc_id", "lang", "CAST(n_chars AS DOUBLE) AS score", "quality AS label"
    )


def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension of every vector as a score for "label below 5"."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "posexplode(embedding) AS (dim, v)", "label AS cls"
    ).selectExpr("dim", "CAST(v AS DOUBLE) AS score", "CAST(cls < 5 AS INT) AS label")


def embedding_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(DIMENSIONS)]
    df = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        "CAST(label < 5 AS INT) AS label",
        *[f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(DIMENSIONS)],
    )
    return df, names


def user_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """One row per user: mean value per event type over all time (0 when absent) and
    whether an error happened in the user's last two days."""
    names = ["click", "purchase", "signup", "view"]
    wide = panel(spark, sf_dir, None).selectExpr(
        "user_id", *[f"coalesce({n}, 0D) AS {n}" for n in names]
    )
    recent = lookback(events(spark, sf_dir).select("user_id", "event_type", "ts"), 2, PANEL)
    hits = recent.where("event_type = 'error'").select("user_id").distinct()
    return (
        wide.join(hits.selectExpr("user_id", "1 AS hit"), "user_id", "left").selectExpr(
            "user_id", *names, "coalesce(hit, 0) AS label"
        ),
        names,
    )


def ranges() -> dict[str, dict]:
    return {n: {"low": f["low"], "high": f["high"]} for n, f in CONFIG.features.items()}

