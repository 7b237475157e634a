"""A training corpus in five stages, from documents to token ids.

Each stage takes all documents that the one before kept, with all their columns; nulls in any column, empty texts, repeated rows, very long
texts and empty tables have the results that the operators' modules state.

Executors keep their JVM, with the heap it has grown to, and their Python workers from stage to stage, so batches between the two are kept small: MOST_BYTES each,
set in the session unless it has a limit of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tidemark.llm.common import frozen, table

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = "4m"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with batches of MOST_BYTES.  The setting stays: what a stage returns runs later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if BATCH not in spark.conf.getAll:
            spark.conf.set(BATCH, MOST_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; without labels of both kinds, all do."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the least doc_id stays; null counts as empty."""
    return exact_dedup.drop_copies(docs)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays; documents without words are classes of their own."""
    return ngram_join.drop_near_copies(docs)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; sources of size 0 go."""
    return mixing.mixed(docs)


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of each document; a null text has no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
