"""From raw documents to token ids: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; the last returns, per kept document,
its id, language, source and token ids.

Defined results: a null, empty or letterless text has no language, so its row
goes in the first stage; of rows that repeat a doc_id one stays, that with the
smallest text; rows without a doc_id are never duplicates and stay; equal texts
of different ids keep the smallest id; an empty table, or an empty benchmark,
passes through every stage; extra columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provenant.llm import bpe, decontaminate, lang_id, near_dups, secret_scan
from provenant.llm.common import prepare, table
from provenant.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    prepare(spark)
    return lang_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return near_dups.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    prepare(spark)
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out."""
    prepare(spark)
    return secret_scan.redact_secrets(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, lang, source, ids, n_tokens."""
    prepare(spark)
    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe_encode", encode_tokens),
]

#: no SQL: the classifier, the hashes and the tokenizer are not expressible
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the documents table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
