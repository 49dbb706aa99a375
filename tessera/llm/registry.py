"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, hmm, langid, licenses, neardup, quality, secrets, sstable, urls
from tessera.llm.common import held_out, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(langid.training_rows(docs))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"], outputs=bpe.DIGESTS)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    joined = {"n_sentences": F.size("sentence_ids").cast("long"), "sentence_ids": F.concat_ws(",", "sentence_ids"), "licences": F.concat_ws(",", "licences")}
    return out.select("doc_id", *[c.alias(k) for k, c in joined.items()], "use")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_secret_scans, op4_byte_bpe, op5_minhash_near_dedup, op6_license_scans, op7_lm_scoring, op8_token_shards, op9_benchmark_decontamination, op10_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.oracle(), "op5_minhash_near_dedup": neardup.oracle(), "op6_license_scans": licenses.oracle(), "op9_benchmark_decontamination": decontam.oracle(), "op10_url_filters": urls.oracle()}
