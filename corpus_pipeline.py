"""The corpus pipeline: language ID, near-dedup, decontamination, personal data, mixing.

Each stage works on all that the one before kept and its decisions take effect. All but the
last return the columns of documents; the last adds copy, the number of a document's copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import language
from kindred.llm.decontamination import find_leaks
from kindred.llm.mixing import emit_copies, mix_sources
from kindred.llm.near_dedup import NearParams, near_duplicates
from kindred.llm.pii import redact
from kindred.plans.scratch import Scratch

#: Texts are rejected whose best language has a lower margin (1: like texts of the language, -1: unlike), as are
#: those without a letter. Of held-out documents in learned languages 4 in 10,000 have one, whatever their number.
LEAST_MARGIN = -0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang is set to what was predicted where it was null. Columns that documents lack don't matter."""
    found = language.identify(docs, language.fit(docs)).where((F.col("lang_pred") != "und") & (F.col("margin") >= LEAST_MARGIN))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """docs with row_, a number of its own for each id and text, and whether any id is null or has several texts. The number is the id, but for such rows one above all ids."""
    key = F.coalesce(F.md5("text"), F.lit(""))
    several = docs.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("doc_id is null or a <> b").select(F.col("doc_id").alias("odd_"))
    odd = docs.select("doc_id", key.alias("key_")).join(scratch.save(several, "odd_ids"), F.col("doc_id").eqNullSafe(F.col("odd_")), "left_semi").distinct()
    odd = scratch.save(odd.select(F.col("doc_id").alias("odd_"), "key_", F.monotonically_increasing_id().alias("turn_")), "odd")
    if odd.isEmpty():
        return docs.withColumn("row_", F.col("doc_id")), False
    top = docs.agg(F.max("doc_id").alias("m")).first()["m"] or 0
    met = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_")) & (key == F.col("key_")), "left")
    return met.withColumn("row_", F.coalesce(F.lit(max(top, 0) + 1) + F.col("turn_"), "doc_id")).select(*docs.columns, "row_"), True


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the least id, null last, of those with equal ids the one whose text has the least MD5.

    Documents are told apart by id and text, so an id may have several texts, and null ids are
    compared like others. Of rows that repeat both, one stays.
    """
    scratch = Scratch(spark)
    own, odd = _numbered(docs, scratch)
    label = near_duplicates(own.select(F.col("row_").alias("doc_id"), "text"), NearParams(), scratch)
    if not odd:
        kept = label.where("kept").select("doc_id")
    else:
        label = label.select(F.col("doc_id").alias("row_"), "component_id").distinct()
        first = own.select("row_", F.struct(F.col("doc_id").isNull(), "doc_id", F.md5("text"), "row_").alias("order_")).join(label, "row_")
        kept = first.groupBy("component_id").agg(F.min("order_").alias("least_")).select(F.col("least_.row_").alias("doc_id"))
    kept = kept.select(F.col("doc_id").alias("row_")).distinct()
    return own.join(kept, "row_", "left_semi").dropDuplicates(["row_"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    leaks = find_leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leak_text")).distinct()
    return docs.join(leaks, F.md5("text") == F.col("leak_text"), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy."""
    return emit_copies(docs, mix_sources(docs))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


#: Fitted models and graph searches have no SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None
