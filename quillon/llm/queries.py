"""Queries over the operators of this subpackage, each with its production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import compaction, conversations, decontaminate, mixing, multi_index, ngram_join, packing, passage_dedup, pii, quality, secrets, store, substring_dedup, warc
from .oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(_read(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark), counts=True)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents"))


def op3_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_bytes(_read(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_read(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(rows).drop("text")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.remove_repeated_passages(_read(spark, sf_dir, "documents"))


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversations.repairs(conversations.damaged(rows), rows)


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(_read(spark, sf_dir, "clicks"), store.new_path(spark, "compacted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_surrogates, op2_ngram_jaccard_join, op3_warc_packages, op4_suffix_array_dedup, op5_secret_ledger, op6_multi_index, op7_pfair_mixing, op8_template_decontamination, op9_quality_classifier, op10_substring_dedup, op11_best_two_fit, op12_conversation_repair, op13_compaction)
}
