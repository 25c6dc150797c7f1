"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects target / source_size copies. Within the source these are
summed up in an order by size, one offset from a seed is added, and a document is emitted
once for every integer its interval crosses: floor(sum + offset) of the interval's end less
that of its start. Because every document of a source expects the same number of copies,
the prefix sum is that number times the document's rank, and the rank is had from counts of
small buckets (source, size class, salt) plus a row number within the bucket: no task ever
holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket, about.
BUCKET = 20_000


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size).

    Sources in code point order, null last, weigh by the cycle and share all words; a target
    stops at cap times its source's size and the excess goes to the others by weight. With
    the sources sorted by cap * size / weight, those before the first that holds its share
    are at their caps, so the reshared level is had from running sums, without a loop.
    """
    by = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count_if(F.lit(True)).alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (turn % len(cycle)) + 1)
    s = by.withColumn("turn", turn).withColumn("w", weight).withColumn("roof", F.lit(cap) * F.col("source_size"))
    line = Window.orderBy((F.col("roof") / F.col("w")).asc(), "turn")
    before, after, all_ = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("roof").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("roof"), F.struct((F.col("roof") / F.col("w")).alias("at"), "turn", "level")))
    level = F.min("fits").over(all_)["level"]
    return s.select("source", "source_size", "n", F.least(F.col("roof").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 7, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, text_key, size (words), source_size, target, copies and taken (copies * size).

    docs needs doc_id, text and source; other columns are not read. A null text has size 0.
    A null source is a source of its own. Rows that repeat count as documents each; rows with
    equal id, source and text may swap their copies. Sources without words and empty tables have targets of 0.
    The same rows and seed give the same copies. text_key is the MD5 of the text.

    Sources are few beside documents: one row of each passes through one task for the targets.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.save(docs.select("doc_id", "source", F.md5("text").alias("text_key"), size.alias("size")), "sizes")
    targets = source_targets(rows.select("source", "size"), cycle, cap)
    # Buckets: sizes in steps of an eighth of a doubling, split by salts so that each holds about BUCKET documents.
    klass = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    t = targets.select(F.col("source").alias("t_source"), F.col("source_size").alias("t_size"), "n", F.col("target").alias("t_target"))
    rows = rows.withColumn("class_", klass)
    counts = rows.groupBy("source", "class_").agg(F.count_if(F.lit(True)).alias("m")).withColumn("salts_", F.greatest(F.lit(1), F.ceil(F.col("m") / BUCKET)).cast("int"))
    counts = counts.select(F.col("source").alias("k_source"), F.col("class_").alias("k_class"), "salts_")
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("class_") == F.col("k_class")), "left").drop("k_source", "k_class")
    rows = rows.withColumn("salt_", F.pmod(_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text_key", F.lit("")))).cast("long"), F.coalesce("salts_", F.lit(1)))).drop("salts_")
    held = rows.groupBy("source", "class_", "salt_").agg(F.count_if(F.lit(True)).alias("m"))
    line = Window.partitionBy("source").orderBy("class_", "salt_").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("base_", F.coalesce(F.sum("m").over(line), F.lit(0)))
    held = held.join(t, held["source"].eqNullSafe(t["t_source"])).select(F.col("source").alias("k_source"), F.col("class_").alias("k_class"), F.col("salt_").alias("k_salt"), "base_", "t_size", "t_target")
    rows = rows.join(held, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("class_") == F.col("k_class")) & (F.col("salt_") == F.col("k_salt")))
    rank = F.col("base_") + F.row_number().over(Window.partitionBy("source", "class_", "salt_").orderBy("size", "doc_id", "text_key"))
    rate = F.when(F.col("t_size") > 0, F.col("t_target") / F.col("t_size")).otherwise(F.lit(0.0))
    offset = _number(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\0null")))).cast("double") / float(1 << 48)
    rows = rows.withColumn("rank_", rank).withColumn("rate_", rate).withColumn("offset_", offset)
    copies = F.floor(F.col("rate_") * F.col("rank_") + F.col("offset_")) - F.floor(F.col("rate_") * (F.col("rank_") - 1) + F.col("offset_"))
    # Rounding may put an interval of length 3 over a fourth integer: never more than the cap.
    rows = rows.withColumn("copies", F.least(copies, F.lit(cap)).cast("long"))
    rows = rows.withColumn("source_size", F.col("t_size")).withColumn("target", F.col("t_target")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", "taken")


def _number(text: Column) -> Column:
    """48 bits of the MD5 of a string, as decimal digits."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10)


def emit_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mixed (of the same docs) takes it, with a column copy from 1 on. Documents with no copy go.

    Rows with equal id, source and text share what the mix takes of them as evenly as it goes.
    Texts move once, to meet their numbers of copies.
    """
    key = lambda source, text: (F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce(source, F.lit("\0")), F.coalesce(text, F.lit("\0")))
    names = ("mix_id_", "mix_source_", "mix_text_")
    m = mixed.select(*[c.alias(n) for c, n in zip(key(F.col("source"), F.col("text_key")), names)], "copies")
    m = m.groupBy(*names).agg(F.sum("copies").alias("mix_sum_"), F.count_if(F.lit(True)).alias("mix_rows_")).where("mix_sum_ > 0")
    own = docs.select("*", *[c.alias(n) for c, n in zip(key(F.col("source"), F.md5("text")), names)])
    joined = own.join(m, list(names)).withColumn("mix_turn_", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))))
    copies = F.floor(F.col("mix_sum_") / F.col("mix_rows_")) + (F.col("mix_turn_") <= F.col("mix_sum_") % F.col("mix_rows_")).cast("int")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)).cast("int")))).where(F.col("copy") <= copies).select(*docs.columns, "copy")


#: mix_sources(documents) with its default parameters, in DuckDB's SQL.
MIX_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, md5(text) AS text_key, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), turned AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM by_source
), weighed AS (
  SELECT *, turn % 3 + 1 AS w, 3 * source_size AS roof FROM turned
), leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(roof) OVER (ORDER BY CAST(roof AS DOUBLE) / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY CAST(roof AS DOUBLE) / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed
), chosen AS (
  SELECT level AS chosen FROM leveled WHERE level * w <= roof ORDER BY CAST(roof AS DOUBLE) / w, turn LIMIT 1
), targets AS (
  SELECT source, source_size, least(CAST(roof AS DOUBLE), coalesce((SELECT chosen FROM chosen), 0.0) * w) AS target FROM leveled
), classes AS (
  SELECT *, CAST(floor(log2(size + 1) * 8) AS INT) AS class_ FROM sizes
), salted AS (
  SELECT *, CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text_key, '')), 1, 12) AS BIGINT)
    % greatest(1, CAST(ceil(count(*) OVER (PARTITION BY source, class_) / {BUCKET}.0) AS BIGINT)) AS salt_ FROM classes
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class_, salt_, size, doc_id NULLS FIRST, text_key NULLS FIRST) AS r FROM salted
), paced AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('7:' || coalesce(k.source, chr(0) || 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS o
  FROM ranked k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(least(floor(rate * r + o) - floor(rate * (r - 1) + o), 3) AS BIGINT) * size AS taken FROM paced
"""
