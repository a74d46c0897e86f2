"""Registered queries of the training-data operators over the driver tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, embeddings, jaccard, language_model, licenses, lines, mixing, quality, search, sharding, substrings, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by balanced label propagation."""
    return sharding.balanced_shards(table(spark, sf_dir, "documents"), 24)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of all documents."""
    return lines.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles of similarity 0.9."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 3, 90, 100)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that stand earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs)


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the hierarchical Pitman-Yor model."""
    return language_model.score_texts(table(spark, sf_dir, "documents"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the word vocabulary."""
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of one label."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


ORACLES["op11_ranked_search"] = search.ORACLE


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents by template markup."""
    return licenses.license_labels(table(spark, sf_dir, "documents"))


ORACLES["op12_license_scan"] = licenses.ORACLE


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, repaired at least cost."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(conversations.damage(rows), rows)
