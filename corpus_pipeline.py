"""A corpus pipeline: five stages, each by an operator of sievewright.llm.

Every stage takes what its predecessor kept and returns the columns of
documents, but for the last, which returns token ids. Stages are written as
Parquet to the shared checkpoint folder and read again.

Null and empty texts go in the first stage. Rows with a null doc_id link with
nothing and are judged by their texts in all other stages. Repeated rows fare
alike, but that of a group of equal or near texts all rows of the smallest
doc_id stay. Ties between languages go to the first by name. An empty table
passes empty through every stage. Extra columns, whatever their names, are
kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import bpe, decontaminate, langid, ngram_join, secrets
from sievewright.llm._shared import cut, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts that no language codes in under 8 bits a byte or has half of the score of, go; a null lang is filled in."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that 5-word shingle Jaccard of 3/4 links, the one with the smallest doc_id stays."""
    return without(docs, ngram_join.link(docs).where("doc_id != component_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth lie in windows of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows where the text changed."""
    changed = "_changed"
    while changed in docs.columns:
        changed = "_" + changed
    clean = secrets.redact(docs, changed=changed)
    return clean.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select([F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of the bytes that they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("byte_bpe", token_ids),
]

#: SQL cannot express the statistics of the first stage or the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
