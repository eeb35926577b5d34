"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is
written and read again as the next stage's ``docs``. All but the last return the columns
of ``docs``. Every stage is right on an empty table, null values, repeated rows and extra columns, as
its operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.common import documents, in_fold, stage
from cohortspark.llm.langid import keep_identified, train_language_model
from cohortspark.llm.mixing import take_words
from cohortspark.llm.packing import pack_documents
from cohortspark.llm.secrets import redact_secrets
from cohortspark.llm.simhash import keep_one_of_each

# A text goes only if no language is likelier than this.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in no language that the labelled rows teach, go."""
    model = train_language_model(docs.filter(~in_fold("doc_id", 3, 1)))
    return keep_identified(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates (three-word shingles, two bits) the document of the least id stays."""
    return keep_one_of_each(docs, width=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask; every document stays."""
    return redact_secrets(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes their words."""
    return take_words(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; every token of every row lies in one."""
    return pack_documents(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]
# XXH64 fingerprints, the trained model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = documents(spark, sf_dir)
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
