"""From samples to audio fingerprints: overlapping Hann frames, chroma energies, smoothing, bits, one vote a second."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAPS = np.array([0.25, 0.5, 1.0, 0.5, 0.25]) / 2.5
#: The pairs of bins that the bits compare: to the next, the third next, and for eight the sixth next.
PAIRS = [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 3) % 12) for i in range(12)] + [(i, (i + 6) % 12) for i in range(8)]


@dataclass(frozen=True)
class ChromaParams:
    """rate: samples a second; size and hop of frames in samples; low and high: Hz that count; scale: of a sample; block: frames that are computed together."""

    rate: int = 11025
    size: int = 4096
    hop: int = 1365
    low: float = 27.5
    high: float = 3520.0
    scale: float = 1 / 32768
    block: int = 64

    def classes(self) -> list[tuple[int, int]]:
        """(bin, class) of the spectrum's bins that count: twelve classes an octave from `low` on, without the first and last bin."""
        freq = {i: i * self.rate / self.size for i in range(1, self.size // 2)}
        return [(i, int(12 * np.log2(f / self.low)) % 12) for i, f in freq.items() if self.low <= f <= self.high]


def chroma_frames(frames: np.ndarray, p: ChromaParams) -> np.ndarray:
    """n x 12 energies of n x size samples."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(p.size) / (p.size - 1)))
    bins, of = map(list, zip(*p.classes()))
    power = np.abs(np.fft.rfft(frames * p.scale * window, axis=1)[:, bins]) ** 2
    return power @ np.eye(12)[of]


def _blocks(samples: DataFrame, series: str, pos: str, value: str, p: ChromaParams, before: int) -> DataFrame:
    """(series, block, frames, at, values): the samples of a block of frames and of those `before` them, and the number of frames of the series. Each sample goes to the one or two blocks that need it, so long series are cut; blocks without a sample are there too."""
    step = p.block * p.hop
    # Block b has frames b * block - before to (b + 1) * block - 1.
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - (p.size - 1) - (p.block - 1) * p.hop) / step))
    last = F.floor((F.col("pos") + before * p.hop) / step)
    slim = samples.where(F.col(pos) >= 0).select(F.col(series).alias("series"), F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    cut = slim.select("series", F.explode(F.sequence(first, last)).alias("block"), F.struct("pos", "v").alias("s"), F.lit(None).cast("long").alias("frames"))
    whole = slim.groupBy("series").agg(F.max("pos").alias("end")).where(F.col("end") >= p.size - 1).select("series", (F.floor((F.col("end") + 1 - p.size) / p.hop) + 1).cast("long").alias("frames"))
    empty = whole.select("series", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("frames") - 1) / p.block))).alias("block"), F.lit(None).cast(cut.schema["s"].dataType).alias("s"), "frames")
    held = cut.union(empty).groupBy("series", "block").agg(F.array_sort(F.collect_list("s")).alias("s"), F.max("frames").alias("frames"))
    return held.where("frames is not null").select("series", "block", "frames", F.col("s.pos").alias("at"), F.col("s.v").alias("values"))


def _each(p: ChromaParams, before: int, finish):
    """Frames of all blocks of a batch as one matrix; finish(chroma, is_first) gives a block's rows from its frames' energies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, frames, spans = [], [], []
            for i, (block, most, at, values) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("block", "frames", "at", "values")])):
                begin = max(0, block * p.block - before)
                n = min((block + 1) * p.block, most) - begin
                line = np.zeros((n - 1) * p.hop + p.size)  # places without a sample are silent
                place = np.array(at, dtype=np.int64) - begin * p.hop
                keep = (place >= 0) & (place < len(line))
                line[place[keep]] = np.array(values, dtype=np.float64)[keep]
                frames.append(np.lib.stride_tricks.sliding_window_view(line, p.size)[:: p.hop])
                spans.append((i, begin, n))
            energy = chroma_frames(np.concatenate(frames), p) if frames else np.zeros((0, 12))
            at = 0
            for i, begin, n in spans:
                out += [(i, f, v) for f, v in finish(begin, energy[at : at + n])]
                at += n
            value = pa.array([v for *_, v in out], pa.list_(pa.float64())) if finish is _energies else pa.array([v for *_, v in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("series").take(pa.array([i for i, *_ in out], pa.int64())), pa.array([f for _, f, _ in out], pa.int64()), value], ["series", "frame", "value"])

    return run


def _energies(begin: int, energy: np.ndarray):
    return [(begin + k, v.tolist()) for k, v in enumerate(energy)]


def _bits(begin: int, energy: np.ndarray):
    """The first four frames of a series, or of what comes before a block, have no smoothed value."""
    if len(energy) < len(TAPS):
        return []
    smooth = sum(w * energy[4 - k : len(energy) - k] for k, w in enumerate(TAPS))
    norm = (smooth**2).sum(axis=1, keepdims=True)
    unit = np.where(norm < 1e-10, 0.0, smooth / np.sqrt(np.where(norm < 1e-10, 1.0, norm)))
    code = sum((unit[:, a] > unit[:, b]).astype(np.int64) << k for k, (a, b) in enumerate(PAIRS))
    return [(begin + 4 + k, int(c)) for k, c in enumerate(code)]


def chroma(samples: DataFrame, series: str, pos: str, value: str, p: ChromaParams = ChromaParams()) -> DataFrame:
    """(series, frame, energies): twelve energies of every whole frame of a series of samples at places from 0 to its last one. Null samples and gaps are silent; a null series is one; of samples at one place the greatest counts."""
    kind = samples.schema[series].dataType.simpleString()
    return _blocks(samples, series, pos, value, p, 0).mapInArrow(_each(p, 0, _energies), f"series {kind}, frame long, value array<double>").withColumnRenamed("value", "energies")


def frame_bits(samples: DataFrame, series: str, pos: str, value: str, p: ChromaParams = ChromaParams()) -> DataFrame:
    """(series, frame, bits): 32 bits of every frame from the fifth on, of energies smoothed over five frames."""
    kind = samples.schema[series].dataType.simpleString()
    return _blocks(samples, series, pos, value, p, 4).mapInArrow(_each(p, 4, _bits), f"series {kind}, frame long, value long").withColumnRenamed("value", "bits")


def fingerprint(samples: DataFrame, series: str, pos: str, value: str, p: ChromaParams = ChromaParams()) -> DataFrame:
    """(series, slot, vote): for each second the bits that more than half of its frames have, the last one too.

    A slot is closed by the first frame of a later second, one at a time, so slots are
    contiguous: the k-th frame that has bits is in slot min(k, its second), or k where
    frames are further apart than a second.
    """
    bits = frame_bits(samples, series, pos, value, p)
    k, second = F.col("frame") - 4, F.floor(F.col("frame") * p.hop / p.rate)
    slot = F.least(k, second) if p.hop <= p.rate else k
    one = F.count_if(F.lit(True))
    votes = [F.count_if(F.shiftrightunsigned("bits", i).bitwiseAND(1) == 1) for i in range(32)]
    need = F.floor(one / 2) + 1
    word = sum((F.when(v >= need, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, v in enumerate(votes)), F.lit(0).cast("long"))
    return bits.groupBy("series", slot.cast("long").alias("slot")).agg(word.alias("vote"))
