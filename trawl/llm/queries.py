"""The queries opN_<name> over whole tables, with production parameters, and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawl.llm import chat, decontaminate, html, langid, mixing, neardup, quality, tokens, toxicity, wavelet
from trawl.llm.common import settle, small_batches, table
from trawl.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.extract(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return wavelet.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.detect(docs, langid.train(docs))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_check(table(spark, sf_dir, "conversations"))
    return chat.read_back(settle(chat.windows(conversations), "windows"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 250)
    return neardup.find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_chat_windows": op9_chat_windows,
    "op10_near_duplicates": op10_near_duplicates,
}
