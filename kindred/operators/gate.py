"""The visual gate of clips found by sound: a few frames of the clip against those of its source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.scalars import global_rank
from kindred.operators.kernels import frame_difference
from kindred.operators.series import CELLS, meet
from kindred.plans.scratch import Scratch

ROWS = 1 << 18  # pairs looked at and handed on at a time


def sample_times(seconds: Column) -> Column:
    """Where a clip is sampled, off its ends: three places from 9 s on, two from 3 s on, else the middle."""
    at = lambda *shares: F.array(*[seconds * F.lit(s) for s in shares])
    return F.when(seconds >= 9.0, at(0.25, 0.5, 0.75)).when(seconds >= 3.0, at(0.33, 0.66)).otherwise(at(0.5))


def nearest_frames(asked: DataFrame, frames: DataFrame) -> DataFrame:
    """(file, at, gray): for each place asked for (file, at), the stored frame (file, ts, gray) that is nearest, the earlier of two as near; none where a file has no frame.

    One sort of each file's frames and places together: the last frame before a place and the
    first after it come from running windows, which stream, so no list of frames is built.
    """
    both = frames.where("ts is not null and gray is not null").select("file", F.col("ts").cast("double").alias("t_"), F.struct(F.col("ts").cast("double").alias("ts"), "gray").alias("frame_"))
    both = both.unionByName(asked.distinct().select("file", F.col("at").alias("t_"), F.lit(None).cast(both.schema["frame_"].dataType).alias("frame_")))
    line = Window.partitionBy("file").orderBy("t_", F.col("frame_").isNull())  # a frame at the very place is before it
    last = F.last("frame_", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("file").orderBy(F.desc("t_"), F.col("frame_").isNotNull())
    after = F.last("frame_", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("before_", last).withColumn("after_", after).where("frame_ is null")
    first = F.col("after_").isNull() | (F.col("before_").isNotNull() & (F.col("t_") - F.col("before_.ts") <= F.col("after_.ts") - F.col("t_")))
    picked = met.select("file", F.col("t_").alias("at"), F.when(first, F.col("before_")).otherwise(F.col("after_")).alias("f_"))
    return picked.where("f_ is not null").select("file", "at", F.col("f_.gray").alias("gray"))


def visual_gate(pairs: DataFrame, frames: DataFrame, least: float = 0.85) -> DataFrame:
    """The rows of pairs with n_compared, similarity (mean; null if nothing was compared) and passes.

    pairs: clip, source, offset, clip_secs, source_secs (a pair once; the offset in seconds). frames: file, ts, gray.
    Places within 0.1 s of either end are left out, and those where a file has no frame; a pair
    of which nothing is compared passes, as do pairs of unknown length.
    """
    keys = ["clip", "source", "offset"]
    known = pairs.where("clip_secs > 0 and source_secs > 0")
    asked = known.withColumn("at", F.explode(sample_times(F.col("clip_secs").cast("double")))).withColumn("source_at", F.col("offset") + F.col("at"))
    asked = asked.where((F.col("source_at") < F.col("source_secs") - 0.1) & (F.col("at") < F.col("clip_secs") - 0.1)).select(*keys, "at", "source_at")
    places = asked.select(F.col("clip").alias("file"), "at").union(asked.select("source", "source_at"))
    found = nearest_frames(places, frames)
    side = lambda file, at, gray: found.select(F.col("file").alias(file), F.col("at").alias(at), F.col("gray").alias(gray))
    met = asked.join(side("clip", "at", "a_"), ["clip", "at"]).join(side("source", "source_at", "b_"), ["source", "source_at"])
    mean = met.groupBy(*keys).agg(F.avg(1 - frame_difference("a_", "b_")).alias("similarity"), F.count_if(F.lit(True)).alias("n_compared"))
    out = pairs.join(mean, keys, "left")
    return out.withColumn("n_compared", F.coalesce("n_compared", F.lit(0))).withColumn("passes", F.coalesce(F.col("similarity") >= least, F.lit(True)))


def _numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.float64)


class _Files:
    """The files of a packed block: ids, secs, where their frames begin and how many there are, and the frames' times and grays, a row each."""

    def __init__(self, z: bytes):
        rows = pa.ipc.open_stream(z).read_next_batch()
        self.ids, self.secs = rows.column("file"), _numbers(rows.column("secs"))
        self.unknown = self.ids.is_null().to_numpy(zero_copy_only=False)
        self.keys = (self.ids.fill_null(0) if pa.types.is_integer(self.ids.type) else self.ids).to_numpy(zero_copy_only=False)
        frames = rows.column("frames")
        self.many = frames.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.base = np.cumsum(self.many) - self.many
        frames = frames.flatten()
        self.ts = _numbers(frames.field("ts"))
        self.ts[np.isnan(self.ts)] = np.inf
        gray = frames.field("gray")
        self.size = gray.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.gray = np.zeros((len(self.size), int(self.size.max(initial=0))))
        self.gray[np.arange(self.gray.shape[1]) < self.size[:, None]] = _numbers(gray.flatten())
        at = rows.column("at")
        many = at.value_lengths().to_numpy(zero_copy_only=False)
        self.at = np.full((len(many), int(many.max(initial=0))), np.nan)
        self.at[np.arange(self.at.shape[1]) < many[:, None]] = _numbers(at.flatten())
        self.at[(self.secs <= 0)[:, None] | ~(self.at < self.secs[:, None] - 0.1)] = np.nan

    def pieces(self, first: int = 0) -> Iterator[tuple[int, int]]:
        """Runs of files whose table of times is bounded."""
        step = max(1, CELLS // (len(np.unique(self.ts)) + 1))
        for low in range(first, len(self.secs), step):
            yield low, min(low + step, len(self.secs))

    def nearest(self, low: int, high: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """f(file, t) for files from low on, before high: the frame that is nearest, the earlier of two as near; -1 where there is none."""
        start, stop = self.base[low], self.base[high - 1] + self.many[high - 1]
        times, rank = np.unique(self.ts[start:stop], return_inverse=True)
        width = len(times) + 1
        cell = np.repeat(np.arange(high - low), self.many[low:high]) * width + rank + 1
        until = np.bincount(cell, minlength=(high - low) * width).reshape(-1, width).cumsum(axis=1, dtype=np.int32)

        def find(file: np.ndarray, t: np.ndarray) -> np.ndarray:
            if stop == start:
                return np.full(len(t), -1)
            n = until[file - low, np.searchsorted(times, t, "right")]
            before = self.base[file] + n - 1
            early, late = self.ts[np.maximum(before, 0)], self.ts[np.minimum(before + 1, len(self.ts) - 1)]
            more = n < self.many[file]
            return np.where((n > 0) & (~more | (t - early <= late - t)), before, np.where(more, before + 1, -1))

        return find


def _compare(clips: _Files, sources: _Files, offset: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    """All pairs of a clip and a longer source of two blocks that are sorted by length."""
    shown = np.full(clips.at.shape, -1)
    for low, high in clips.pieces():
        find = clips.nearest(low, high)
        for k in range(clips.at.shape[1]):
            shown[low:high, k] = find(np.arange(low, high), clips.at[low:high, k])
    shown[np.isnan(clips.at)] = -1
    width = max(clips.gray.shape[1], sources.gray.shape[1], 1)
    wide = lambda g: np.pad(g, ((0, 0), (0, width - g.shape[1])))
    gray, gray2, ones = wide(clips.gray), wide(sources.gray), np.ones(width)
    longer = np.searchsorted(sources.secs, clips.secs, "right")  # the first source that is longer
    for low, high in sources.pieces(int(longer.min(initial=len(sources.secs)))):
        find = sources.nearest(low, high)
        step = max(1, min(ROWS, CELLS // width) // (high - low))
        for at in range(0, len(clips.secs), step):
            some = np.arange(at, min(at + step, len(clips.secs)))
            many = np.maximum(high - np.maximum(longer[some], low), 0)
            c = np.repeat(some, many)
            if not len(c):
                continue
            s = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many) + np.maximum(longer[c], low)
            off = offset(clips.keys[c], sources.keys[s], clips.secs[c], sources.secs[s])
            known = ~(clips.unknown[c] | sources.unknown[s])
            compared, met, total = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c))
            for k in range(clips.at.shape[1]):
                t = off + clips.at[c, k]
                good = np.flatnonzero(known & (shown[c, k] >= 0) & (t < sources.secs[s] - 0.1))
                a, b = shown[c[good], k], find(s[good], t[good])
                good, a, b = good[b >= 0], a[b >= 0], b[b >= 0]
                alike = (clips.size[a] == sources.size[b]) & (clips.size[a] > 0)
                alike = np.where(alike, 1 - np.abs(gray[a] - gray2[b]) @ ones / np.maximum(clips.size[a], 1) / 256, np.nan)
                compared[good] += 1
                total[good] += np.nan_to_num(alike)
                met[good] += ~np.isnan(alike)
            mean = pa.array(total / np.maximum(met, 1), mask=met == 0)
            yield pa.RecordBatch.from_arrays([clips.ids.take(pa.array(c)), sources.ids.take(pa.array(s)), pa.array(compared), mean], ["clip", "source", "n_compared", "similarity"])


def gate_every_pair(files: DataFrame, frames: DataFrame, offset: Callable[..., np.ndarray], least: float = 0.85, block: int | None = None) -> DataFrame:
    """(clip, source, n_compared, similarity, passes) of each file and each longer one, as visual_gate has it for the same pairs.

    files: file (each once), secs. frames: file, ts, gray (whole numbers). offset(clip, source,
    clip_secs, source_secs): seconds, of arrays; pairs with a null id have none, so nothing of
    them is compared. Pairs aren't listed, joined or shuffled: files are dealt to blocks by
    length with their frames, and a task holds two blocks. A file's frames must fit a task.
    """
    spark, scratch = files.sparkSession, Scratch(files.sparkSession)
    name = files.schema["file"].dataType.simpleString()
    kept = frames.where("ts is not null and gray is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), "gray"))).alias("frames"))
    slim = files.where("secs is not null").select("file", F.col("secs").cast("double").alias("secs")).join(kept, "file", "left")
    slim = slim.select("file", "secs", sample_times(F.col("secs")).alias("at"), F.coalesce("frames", F.array().cast(kept.schema["frames"].dataType)).alias("frames"))
    ranked = scratch.save(global_rank(slim, [F.col("secs").asc(), F.col("file").asc()], "r"), "ranked")
    count, most = ranked.agg(F.count_if(F.lit(True)), F.max(F.size("frames") + F.size(F.flatten("frames.gray")))).first()
    block = block or max(1, min(8192, max(128, count // 32), CELLS // max(most or 1, 1)))
    rows = F.array_sort(F.collect_list(F.struct("r", "file", "secs", "at", "frames")))
    blocks = ranked.groupBy(F.floor((F.col("r") - 1) / block).alias("i")).agg(rows.alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = pa.RecordBatch.from_struct_array(batch.column("rows").slice(k, 1).flatten())
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(held)
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(k, 1), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["i", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _compare(_Files(batch.column("z")[k].as_py()), _Files(batch.column("z2")[k].as_py()), offset)

    packed = scratch.save(blocks.mapInArrow(pack, "i long, z binary"), "blocks")
    out = meet(packed, -(-count // block)).mapInArrow(run, f"clip {name}, source {name}, n_compared long, similarity double")
    return out.withColumn("passes", F.coalesce(F.col("similarity") >= least, F.lit(True)))
