"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kindred.llm import language, toxicity
from kindred.llm.clustering import CLUSTER_SQL, cluster_vectors
from kindred.llm.decontamination import find_leaks
from kindred.llm.embedding_dedup import near_duplicate_vectors
from kindred.llm.html_text import extract_text
from kindred.llm.line_dedup import LINES_SQL, dedup_lines
from kindred.llm.merkle import MERKLE_SQL, lower_some, manifest
from kindred.llm.mixing import MIX_SQL, mix_sources
from kindred.llm.near_dedup import NearParams, near_duplicates
from kindred.llm.pii import digest, find_pii
from kindred.llm.suffix_dedup import remove_repeats
from kindred.llm.tokens import count_tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by four-word shingles at 0.8."""
    return near_duplicates(_read(spark, sf_dir, "documents"), NearParams(words=4))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in every document."""
    return digest(find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity chain, fitted on labels, over every document."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without strings of 400 bytes that start anywhere else."""
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(_read(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level BPE vocabulary."""
    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents share."""
    return dedup_lines(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and proof of every document, a fifth of the proofs folded over lower-cased text."""
    docs = _read(spark, sf_dir, "documents")
    return manifest(docs, lower_some(docs))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components."""
    return cluster_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: The others are fitted models, graph searches and byte sorts, which SQL can't express: tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_mixing": MIX_SQL, "op11_line_dedup": LINES_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_centroid_clustering": CLUSTER_SQL}
