"""Corpus pipeline: documents to tokens, through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontam, langid, neardup, secrets
from tessera.llm.common import read, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model determines; it learns from the labelled ones that aren't held out.

    Null texts, empty ones and texts without a letter go, and so do all if no document has a label. Equal rows fare alike.
    """
    return langid.accept(docs, langid.train(langid.training_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows without an id stay."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a passage of the benchmark; null and empty texts stay."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by its kind; null and empty texts as they are. n_chars stays the source's."""
    return secrets.without_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of all documents, row by row; a null text has no ids."""
    return bpe.encode(docs, keep=["doc_id"], outputs=("ids", *bpe.DIGESTS))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("tokenize", tokenize)]
#: Fitted models and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
