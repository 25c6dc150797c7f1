"""Incremental ingest: new files of a folder are merged into a versioned catalogue, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.operators.joins import upsert


def latest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a catalogue under root (of those before a batch, if one is given), or None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted(n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))
    done = [n for n in done if before is None or n < f"v{before:09d}"]
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def ingest(spark: SparkSession, source: str, schema: StructType, root: str, key: str, watch: list[str], checkpoint: str):
    """A query that merges all new Parquet files of source into the catalogue and stops (availableNow).

    Each batch reads the newest version before its own and writes version v<batch id>, so a
    batch that is run again, even after its write succeeded, writes the same version. Within a batch the row with the greatest watched values wins.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(key).agg(F.max(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*").select(*batch.columns)
        old = latest(spark, root, batch_id)
        out = new if old is None else upsert(old, new, key, watch).drop("action")
        out.write.mode("overwrite").parquet(f"{root}/v{batch_id:09d}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, source: str, schema: StructType, root: str, checkpoint: str, every: str | None = None):
    """Running counts by event_type, a version a batch under root, of which latest reads the newest; every (such as "5 minutes"): keeps running and checkpoints that often, else all there is and stop."""
    counts = spark.readStream.schema(schema).parquet(source).groupBy("event_type").agg(F.count_if(F.lit(True)).alias("n"))
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{root}/v{batch_id:09d}")
    writer = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def changes(spark: SparkSession, source: str, schema: StructType, key: str, root: str, checkpoint: str):
    """A feed of keys whose newest row changed, with that row, as Parquet files under root in a folder a batch (column batch); a batch that runs again writes its own folder anew."""
    rows = spark.readStream.schema(schema).parquet(source)
    newest = rows.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("r"), F.count_if(F.lit(True)).alias("n_seen")).select(key, "r.*", "n_seen")
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
