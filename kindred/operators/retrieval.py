"""Ranked retrieval by BM25 over an inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch


@dataclass(frozen=True)
class Index:
    """postings: term, id, weight (a term's part of the score of a document, but for how often a query has it)."""

    postings: DataFrame


def _terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): how often each word of letters and digits, A-Z lower-cased, is in a text."""
    words = F.split(F.lower(F.col(text)), "[^a-z0-9]+")
    return texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key_"), F.explode(words).alias("term")).where("term <> ''").groupBy("key_", "term").agg(F.count_if(F.lit(True)).alias("n"))


def bm25_index(docs: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75, scratch: Scratch | None = None, queries: DataFrame | None = None) -> Index:
    """Postings with their weights, saved by term; lengths and document counts are sums over the postings.

    Rows that share a key are one document; null keys and texts are left out. One row of totals is broadcast.
    queries: texts in a column of the name of text; only their words' postings are weighed and saved, with
    lengths and counts over all words as before.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tf = scratch.save(_terms(docs, key, text), "terms")
    length = tf.groupBy("key_").agg(F.sum("n").alias("len"))
    total = length.agg(F.count_if(F.lit(True)).alias("docs"), F.avg("len").alias("mean"))
    if queries is not None:
        tf = tf.join(_terms(queries.select(F.lit(0).alias("q"), text), "q", text).select("term"), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count_if(F.lit(True)).alias("df"))
    met = tf.join(length, "key_").join(df, "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return Index(scratch.save(met.select("term", F.col("key_").alias("id"), weight.alias("weight")), "postings"))


def bm25_top(queries: DataFrame, key: str, text: str, index: Index, k: int = 20) -> DataFrame:
    """(query, id, rank, score): the k best documents of each query, scores to six places; as good ones by id. A word that a query repeats counts as often.

    The rank is cut to k within each task before rows meet, so a query whose words are everywhere moves k rows a task.
    """
    asked = _terms(queries, key, text).select(F.col("key_").alias("query"), "term", F.col("n").alias("times"))
    scored = index.postings.join(asked, "term").groupBy("query", "id").agg(F.round(F.sum(F.col("weight") * F.col("times")), 6).alias("score"))
    line = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query", "id", "rank", "score")
