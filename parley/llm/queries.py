"""The registered queries of this subpackage: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import (alignment, edit_embedding, exact_dedup, html_blocks, importance, jaccard_join, langid, mixing, oracle, packing, pii,
                        sharding, toxicity, warc)
from parley.llm.common import configure, fold


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near copies of every document."""
    return jaccard_join.jaccard_join(_table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, folder, "documents")
    net = langid.train(langid.samples(docs))
    return langid.identify(docs.select("doc_id", "text"), net).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(_table(spark, folder, "documents"))


def op8_edit_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document, and its likeness to the edited and the next one."""
    return edit_embedding.describe(_table(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.shard(_table(spark, folder, "documents")).drop("map_version")


def op10_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(_table(spark, folder, "pages"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Weight and rank of every document for a draw towards the benchmark."""
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as its WARC record tells it, written and read back."""
    return warc.archive(_table(spark, folder, "pages"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every document."""
    return alignment.align(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of corpus_pipeline."""
    import corpus_pipeline  # it imports this subpackage

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_jaccard_join, op2_packing, op3_language_id, op4_toxicity, op5_exact_dedup, op6_mixing, op7_pii, op8_edit_embedding,
    op9_sharding, op10_html_blocks, op11_importance, op12_warc, op13_alignment, pipeline)}

#: Checking SQL of the queries that SQL can express; tests/llm holds the others against brute force.
ORACLES: dict[str, str] = oracle.ORACLES
