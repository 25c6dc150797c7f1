"""Lines that many documents share, by levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table bucketed and sorted by the 128-bit hash of a line's key; each row holds the
number of documents that have the line and the largest of their ids. A batch of documents is
joined with the runs bucket by bucket, without a shuffle of the runs: hashes that the runs
have settled (enough documents, and a larger id than any of the batch) are left out, the
others become a run of level 0. As soon as a level has `fanout` runs, they are merged into
one run of the next level. The order of the batches does not matter.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch

#: The white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineParams:
    """chars: least code points of a key; documents: least documents that share it; batches: parts in which dedup_lines adds a table; fanout: runs of a level that are merged into one of the next."""

    chars: int = 40
    documents: int = 5
    batches: int = 4
    fanout: int = 2


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. The built-in lower is as good, and much faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, chars: int = 40) -> DataFrame:
    """(doc_id, text_key, pos, h): the place and the hash of the key of each line with a key of at least `chars` code points. text_key is the MD5 of the text."""
    lines = docs.where(F.octet_length("text") >= chars).select("doc_id", F.unhex(F.md5("text")).alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line_"))
    key = F.btrim(F.col("line_"), F.lit(BLANKS))
    lines = lines.where((F.octet_length("line_") >= chars) & (F.length(key) >= chars))
    return lines.select("doc_id", "text_key", "pos", F.unhex(F.md5(ascii_lower(key))).alias("h"))


class LineRuns:
    """Levelled runs (h, n, top): n documents hold the line with the hash h, the largest id among them is top.

    n is exact below `documents`; beyond, it is at least that. Batches may come in any
    order, but each document in one batch only. A null id is an id like others, less than all.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, params: LineParams = LineParams()):
        self.spark, self.scratch, self.params = spark, scratch, params
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _merge(self, names: list[str], level: int) -> None:
        """Merge runs bucket by bucket, without a shuffle. (A union of bucketed tables followed by groupBy is not safe: Spark 4.1 may leave out the exchange.)"""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h", F.col("n").alias("m_"), F.col("top").alias("other_"))
            met = a.join(b, "h", "full")
            return met.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m_", F.lit(0))).cast("long").alias("n"), F.greatest("top", "other_").alias("top"))

        self._write(reduce(both, [self.spark.table(n) for n in names]), level)
        self.drop(names)

    def drop(self, names: list[str]) -> None:
        """Forget runs and delete their files."""
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.delete(f"{self.scratch.root}/{name}")

    def add(self, lines: DataFrame) -> None:
        """Add a batch (doc_id, h). What the runs have settled is left out of the batch's run."""
        own = lines.select("h", "doc_id").distinct().groupBy("h").agg(F.count_if(F.lit(True)).alias("n"), F.max("doc_id").alias("top"))
        runs = [n for level in self.levels for n in level]
        seen, last = F.lit(0), []
        for i, name in enumerate(runs):
            run = self.spark.table(name).select("h", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}"))
            own = own.join(run, "h", "left")
            seen, last = seen + F.coalesce(f"n{i}", F.lit(0)), [*last, F.col(f"top{i}")]
        if runs:
            largest = F.greatest(*last, last[0])  # two arguments at least
            settled = (seen >= self.params.documents) & (F.col("top").isNull() | F.coalesce(largest >= F.col("top"), F.lit(False)))
            own = own.where(~settled)
        self._write(own.select("h", "n", "top"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.params.fanout:
            full, self.levels[level] = self.levels[level], []
            self._merge(full, level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(h, top) of the lines that enough documents hold, of all runs merged into one."""
        runs = [n for level in self.levels for n in level]
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels]
            self._merge(runs, len(self.levels))
            runs = self.levels[-1]
        return self.spark.table(runs[0]).where(F.col("n") >= self.params.documents).select("h", "top")

    def close(self) -> None:
        """Drop all runs."""
        self.drop([n for level in self.levels for n in level])
        self.levels = []


def dedup_lines(docs: DataFrame, params: LineParams = LineParams(), texts: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256; with texts=True also kept (the lines that stay).

    A line's key is the line without white space at both ends and with A-Z lower-cased. A key
    of at least params.chars code points that at least params.documents documents hold loses
    all its lines but those in the document with the largest id.

    docs needs doc_id and text; other columns are not read. A null or empty text is one empty
    line. Rows that share an id are one document, so copies of a row count once and stay or go
    alike; a null id is an id like others, less than all. A text of one line that goes leaves
    an empty text. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select("doc_id", "text")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(params.batches)).cast("int")
    lines = scratch.save(line_hashes(rows, params.chars).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, scratch, params)
    for i in range(params.batches):
        runs.add(lines.where(F.col("batch") == i))
    often = scratch.save(runs.frequent(), "frequent")  # saved, so that the adaptive skew join may split the lines of a hot hash
    runs.close()
    gone = lines.join(often, "h").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), "text_key").agg(F.collect_set("pos").alias("gone"))
    whole = F.coalesce("text", F.lit(""))
    own = rows.withColumn("own_key", F.unhex(F.md5("text")))
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("text_key")), "left")
    parts = F.split(whole, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    size = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    out = out.select("doc_id", size.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if texts else []))


#: dedup_lines(documents) with its default parameters, in DuckDB's SQL.
LINES_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l
), f AS (
  SELECT key AS often, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5
), m AS (
  SELECT rid, doc_id, line, pos, often IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM k LEFT JOIN f ON key = often
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
