"""Change feeds with before and after images, and job life cycles that refuse illegal steps.

State is kept per key by Structured Streaming; the feed goes to Parquet files in append mode,
so it is as large as the changes and never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: From a job's state (None: no job yet) by command to the next; what is not here is refused.
JOB_STEPS: dict[str | None, dict[str, str]] = {
    None: {"create": "pending"},
    "pending": {"start": "running", "cancel": "cancelled"},
    "running": {"progress": "running", "finish": "complete", "fail": "failed", "cancel": "cancelled"},
    "complete": {"create": "pending"},
    "failed": {"create": "pending"},
    "cancelled": {"create": "pending"},
}


def _fold(kind: str, order: list[str], steps: dict | None):
    """A state function. steps None: the state is the image, and rows that leave it as it is give nothing."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, seq = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values([*order, "image_"], na_position="first")
        out = []
        for image in rows["image_"]:
            image = None if pd.isna(image) else image
            after = image if steps is None else steps.get(now, {}).get(image)
            if steps is None and (after is None or after == now):
                continue
            seq += 1
            accepted = after is not None
            action = "refuse" if not accepted else "insert" if now is None else "update"
            out.append((key[0], seq, action, image if steps is not None else None, now, after if accepted else now))
            now = after if accepted else now
        if out:
            state.update((now, seq))
        yield pd.DataFrame(out, columns=["key", "seq", "action", "command", "before", "after"])

    return run


def _feed(rows: DataFrame, key: str, order: list[str], image: Column, steps: dict | None) -> DataFrame:
    """(key, seq, action, command, before, after) of a stream. Rows with a null key are left out.

    Within a batch a key's rows go in the given order (rows that tie: by image); batches go as
    they come. A batch's rows of one key are held by one task.
    """
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key_"), image.alias("image_"), *order)
    return slim.groupBy("key_").applyInPandasWithState(_fold(kind, order, steps), f"key {kind}, seq long, action string, command string, before string, after string", "now string, seq long", "append", GroupStateTimeout.NoTimeout)


def change_feed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each change of a key's row: before and after as JSON of all columns but the key and the order. Rows that change nothing give none."""
    image = F.to_json(F.struct(*[c for c in rows.columns if c != key and c not in order]))
    return _feed(rows, key, order, image, None).drop("command")


def job_feed(commands: DataFrame, key: str, order: list[str], command: Column, steps: dict = JOB_STEPS) -> DataFrame:
    """Each command on a job with the state before and after it; action refuse where the life cycle has no such step."""
    return _feed(commands, key, order, command, steps)


def newest(feed: DataFrame) -> DataFrame:
    """(key, seq, state): what a feed's accepted changes leave, replayed from the images alone."""
    return feed.where("action <> 'refuse'").groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("after", "seq").alias("state"))


def broken_images(feed: DataFrame) -> DataFrame:
    """Rows of a feed whose image before is not the image after the row before it: none in a whole feed."""
    line = Window.partitionBy("key").orderBy("seq")
    return feed.withColumn("was_", F.lag("after").over(line)).where(~F.col("before").eqNullSafe(F.col("was_"))).drop("was_")


def to_files(feed: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append a feed to Parquet files. every (such as "5 minutes"): keep running and checkpoint that often, else take all there is and stop."""
    writer = feed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
