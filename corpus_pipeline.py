"""From raw documents to packed training sequences, in stages that each call one corpus operator.

A stage gets the session, the documents that the stage before kept, and the folder of tables. Its result is written
as Parquet and read again for the next one. All but the last return the columns of ``documents``.

Nulls, empty texts, ties, repeated rows and empty tables: a null or empty text has no language, so the first stage drops
it; rows that repeat become one in the second stage; a null doc_id is a document like others, the last of its group;
extra columns pass through all stages but the last; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lekhani.llm import dedup_blocks, jaccard, langid, mixing, packing
from lekhani.llm.common import shared_dir
from lekhani.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not known go: null, empty, without a letter, or unlike all profiles."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays, null last; of rows that repeat, one."""
    return dedup_blocks.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with 80 % of five-word shingles in common, the one with the smallest doc_id stays."""
    return jaccard.drop_near(docs, words=5, share=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none where it takes none; null sources are one source."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Profiles, components of a similarity join and tokenizer ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: pieces of documents and their places in sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
