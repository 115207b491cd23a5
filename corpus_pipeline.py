"""A training corpus from `documents`: language ID, near-dedup, decontamination, mixing, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawl.llm import decontaminate, langid, mixing, neardup, wavelet
from trawl.llm.common import discard, settle, small_batches, table

#: A document whose predicted language has a smaller share of the evidence is rejected.
LEAST_SHARE = 0.3
TOKENIZER = "byte_bpe_50k.json"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt from docs; documents without letters (null and empty texts too) or of no clear language go.

    Repeated rows have one fate; of languages with equal evidence the first by code point is taken, which doesn't
    matter here. If no row has a language, nothing can be learnt and all go. An empty table stays one.
    """
    small_batches(spark)
    return langid.confident(docs, langid.train(docs), LEAST_SHARE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup; the document of the least id of each component stays.

    Null and empty texts are linked with nothing and stay. A null id is never the least; rows of null ids that are
    linked with each other only stay. Rows of one id and text have one fate, so repeated rows of a least id stay all.
    An empty table stays one.
    """
    small_batches(spark, 250)
    return neardup.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination against `benchmark`; documents in which any of its windows occurs go.

    Null and empty texts, null ids and repeated rows of clean texts stay as they are. An empty table or an empty
    benchmark changes nothing.
    """
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it, twice at most.

    Texts without words (null ones too) are taken with the certain copies of their source. A null source is a source.
    Equal rows share their copies evenly; ranks that tie go by id and size. An empty table stays one.
    """
    return mixing.mixed(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have one token, their end; null ids come first; rows of one id are in order of a hash of their
    texts, equal ones side by side. An empty table gives no files and no rows.
    """
    small_batches(spark)
    return wavelet.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", by_language),
    ("near-dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", to_weights),
    ("token files", to_token_files),
]

#: SQL can express neither language ID nor MinHash sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Of the stages' tables only the last one read is kept."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(*held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
