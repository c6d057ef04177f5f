"""From raw documents to packed training sequences: five stages, each one operator of `parley.llm`.

Every stage takes what its predecessor kept; all but the last give rows in the columns of `documents`. A stage's result
is written as Parquet in the session's shared folder and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import exact_dedup, jaccard_join, langid, mixing, packing
from parley.llm.common import configure, keep


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without any letter, or that score below labelled texts of their length, go."""
    configure(spark)
    return langid.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return jaccard_join.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated or cut, that the mix takes."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", identify_languages), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't train the network of the first stage; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
