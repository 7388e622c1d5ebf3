"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm import bpe, exact, forest, language, lm, middle, mixing, neardup, quality, simhash, toxicity, warc, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.edited_fingerprints(_table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(_table(spark, folder, "documents"))


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(_table(spark, folder, "documents"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(_table(spark, folder, "pages"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return middle.middle_digests(_table(spark, folder, "documents"))


def op12_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_quality": op2_quality,
    "op3_language_model": op3_language_model,
    "op4_mix_sources": op4_mix_sources,
    "op5_language": op5_language,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_minhash_forest": op12_minhash_forest,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op4_mix_sources": mixing.MIX_SQL,
    "op7_exact_dedup": exact.EXACT_SQL,
    "op10_warc": warc.WARC_SQL,
    "op11_fill_in_middle": middle.MIDDLE_SQL,
}
