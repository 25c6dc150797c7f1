"""Intermediate tables in the folder that all executors share.

A saved table cuts the lineage of iterative plans and outlives lost executors: it is
read again from the shared folder, never from an executor's own disk.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a temporary folder is made if all runs on this machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Named Parquet tables of one run, under a folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kindred-{uuid.uuid4().hex}"
        self.seq = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """by: a column with few values, by which files are parted, so that filters on it read their own files only."""
        self.seq += 1
        path = f"{self.root}/{self.seq:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def delete(self, path: str) -> None:
        """Delete a file or folder of this run."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no pending plan reads any more, and let Spark drop the shuffle files behind them."""
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                self.delete(path)
        self.tidy()

    def tidy(self) -> None:
        """Shuffle files go once the driver has collected the plans that made them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
