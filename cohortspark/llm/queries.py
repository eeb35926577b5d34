"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import documents, in_fold, stage
from .filter_audit import audit_filters, audit_sql, document_failures
from .fingerprints import fingerprint_documents
from .langid import predict_languages, train_language_model
from .lm import held_out_scores
from .merkle import audit_manifest, manifest_sql
from .mixing import mix_sources, mixing_sql
from .packing import pack_documents
from .secrets import find_secrets
from .simhash import near_duplicates
from .substrings import remove_repeats
from .token_counts import count_tokens
from .vptree import nearest_by_product
from .warc import archive_sql, plan_records, read_archives, resolve_revisits, write_archives

QUERIES = {}
ORACLES = {}


def query(plan):
    QUERIES[plan.__name__] = plan
    return plan


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = in_fold("doc_id", 3, 1)
    model = train_language_model(docs.filter(~held_out))
    return predict_languages(docs, model, ("doc_id",)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query
def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


@query
def op3_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(documents(spark, sf_dir))


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_mix_sources"] = mixing_sql()


@query
def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_product(
        spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % 20 == 0
    )


@query
def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return audit_filters(document_failures(documents(spark, sf_dir), labels), "ABCDE", ("good", "toxic"))


ORACLES["op11_filter_audit"] = audit_sql()


@query
def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(plan_records(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")), folder)
    # One pass over the archives: resolving reads the found records three times.
    return resolve_revisits(stage(read_archives(spark, folder, payloads=False)))


ORACLES["op12_warc_salvage"] = archive_sql()


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_manifest(documents(spark, sf_dir), in_fold("doc_id", 3, 0))


ORACLES["op13_merkle_manifest"] = manifest_sql()
