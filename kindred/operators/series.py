"""All pairs of series, in blocks: a task holds two blocks of series and slides each of one over all of the other at once.

Series are dealt to blocks by length and content and packed, so a block is sent once for each
other block, not once for each other series. Copies within a block are looked at once and
share what is found. Where two blocks hold few different values, the scores of all
alignments of many series are one matrix product of one-hot places; else the totals of set
bits rule out alignments. Both only rule out what can't be in the result, so it is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.functions.scalars import global_rank
from kindred.operators.kernels import MISS_BUDGET
from kindred.plans.scratch import Scratch

VALUES = 64  # different values of two blocks, at most, for matrix products
CELLS = 1 << 22  # cells of a matrix held at a time, about
ROWS = 1 << 20  # pairs handed on at a time
TILE = 504  # series of the second block that meet all copies of some of the first before the next ones do


@dataclass(frozen=True)
class Kernel:
    """score(u, v): of places, small whole numbers; can(total, n): whether the scores of n places may give a result; bound(bits, n): the same by the least number of differing bits; exact(short, window) of n columns: (good, keys, columns), where the least keys of a pair win, then the lower offset. offset: whether the last column is the offset. slide: False if only offset 0 counts, and all pairs have a result. Of equally long series, either may be the short one."""

    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    can: Callable[[np.ndarray, int], np.ndarray]
    bound: Callable[[np.ndarray, int], np.ndarray]
    exact: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, tuple, tuple]]
    offset: bool = True
    slide: bool = True


def _places(n: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of all alignments of n places, rows in order and offsets rising."""
    many = np.maximum(lengths - n + 1, 0)
    row = np.repeat(np.arange(len(lengths)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _least_bits(short: np.ndarray, longs: np.ndarray, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The least number of differing bits that the totals of set bits allow."""
    total = np.concatenate([np.zeros((len(longs), 1), dtype=np.int64), np.cumsum(np.bitwise_count(longs), axis=1, dtype=np.int64)], axis=1)
    n = len(short)
    return np.abs(total[row, offset + n] - total[row, offset] - int(np.bitwise_count(short).sum()))


def _first_of_each(row: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Places of the least entry of each row, by the given keys."""
    order = np.lexsort([*by[::-1], row])
    new = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    return order[new]


def hamming_window(least_pct: int) -> Kernel:
    """(bits, offset) of the best alignment of 32-bit blocks, the lowest offset of equal ones, where it is least_pct % alike or more."""
    can = lambda bits, n: bits * 100 <= n * 32 * (100 - least_pct)

    def exact(short: np.ndarray, window: np.ndarray):
        bits = np.bitwise_count(window ^ short).sum(axis=1, dtype=np.int64)
        return can(bits, short.shape[1]), (bits,), (bits,)

    return Kernel(lambda u, v: np.bitwise_count(u ^ v), can, can, exact)


def tolerant_runs(bits: int, gap: int, least: tuple[int, int], width: int = 64) -> Kernel:
    """(match, run, offset) of the best alignment with gaps, as kernels.sliding_runs has it, where at least least[0] of least[1] places match."""
    can = lambda match, n: match * least[1] >= n * least[0]
    # Places that match differ in `bits` at most, others in `width`: so many at least must miss.
    bound = lambda total, n: can(n - np.maximum(0, -(-(total - bits * n) // (width - bits))), n)

    def exact(short: np.ndarray, window: np.ndarray):
        n = short.shape[1]
        hits = np.bitwise_count(window ^ short) <= bits
        budget = int(np.ceil(n * MISS_BUDGET))
        match, length, bridged, best, miss = np.zeros((5, len(short)), dtype=np.int64)
        for k in range(n):
            go, hit = miss <= budget, hits[:, k]
            bridge = ~hit & (bridged < gap)
            length = np.where(go, np.where(hit | bridge, length + 1, 0), length)
            bridged = np.where(go, np.where(bridge, bridged + 1, 0), bridged)
            best = np.where(go & hit, np.maximum(best, length), best)
            match += go & hit
            miss += go & ~hit
        return can(match, n), (-match, -best), (match, best)

    return Kernel(lambda u, v: np.bitwise_count(u ^ v) <= bits, can, bound, exact)


def prefix_bits() -> Kernel:
    """(bits, n): differing bits over the places both have."""
    every = lambda total, n: np.ones(np.shape(total), dtype=bool)

    def exact(short: np.ndarray, window: np.ndarray):
        bits = np.bitwise_count(window ^ short).sum(axis=1, dtype=np.int64)
        return every(bits, 0), (), (bits, np.full(len(bits), short.shape[1]))

    return Kernel(lambda u, v: np.bitwise_count(u ^ v), every, every, exact, offset=False, slide=False)


def alike(bits: Column, places: Column) -> Column:
    """The share of like bits of 32-bit places, to nine digits, halves up: in whole numbers, which is exact and far cheaper than rounding doubles."""
    all_ = places.cast("long") * 32
    return F.call_function("div", (all_ - bits) * 2_000_000_000 + all_, all_ * 2) / 1e9


def _candidates(kernel: Kernel, shorts: np.ndarray, longs: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(short, row, offset) of the alignments that may give a result, all those of a short and a row together; shorts are equally long."""
    n = shorts.shape[1]
    values = np.unique(np.concatenate([np.unique(shorts), np.unique(longs)]))
    if len(values) > VALUES:
        for a, short in enumerate(shorts):
            row, offset = _places(n, lengths)
            can = kernel.bound(_least_bits(short, longs, row, offset), n)
            yield np.full(int(can.sum()), a), row[can], offset[can]
        return
    table = kernel.score(values[:, None], values[None, :]).astype(np.float64)
    kind = np.float32 if n * table.max() < 1 << 24 else np.float64  # sums stay exact
    left = table.astype(kind)[np.searchsorted(values, shorts)].reshape(len(shorts), -1)
    hot = np.eye(len(values), dtype=kind)[np.searchsorted(values, longs)]
    step = len(values)
    at = 0
    while at < len(longs):
        width = int(lengths[at:].max())
        take = max(1, CELLS // max(1, (width - n + 1) * max(n * step, len(shorts))))
        row, offset = _places(n, lengths[at : at + take])
        # Alignments of one series are at most CELLS cells at a time; longer ones are cut by offsets, whose results meet again in _best.
        some = max(1, CELLS // max(n * step, len(shorts))) if take == 1 else len(row)
        flat = hot[at : at + take].reshape(min(take, len(longs) - at), -1)
        kept = []
        for low in range(0, len(row), max(some, 1)):
            r, o = row[low : low + some], offset[low : low + some]
            windows = np.lib.stride_tricks.sliding_window_view(flat, n * step, axis=1)[r, o * step]
            a, k = np.nonzero(kernel.can(left @ windows.T, n))
            kept.append((a, at + r[k], o[k]))
        if kept:
            yield tuple(np.concatenate(c) for c in zip(*kept))
        at += take


def _best(kernel: Kernel, shorts: np.ndarray, longs: np.ndarray, lengths: np.ndarray, first: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(short, row, *columns) of the pairs that have a result; first: the place of the first short among longs, if they are of one block, of which only the same and later rows count."""
    n = shorts.shape[1]
    if not kernel.slide:
        for low in range(0, len(longs), 2048):
            part = longs[low : low + 2048, :n]
            start = [0 if first is None else min(len(part), max(0, a + first - low)) for a in range(len(shorts))]
            cols = zip(*(kernel.exact(shorts[a : a + 1], part[at:])[2] for a, at in enumerate(start)))
            many = [len(part) - at for at in start]
            yield (np.repeat(np.arange(len(shorts)), many), np.concatenate([np.arange(low + at, low + len(part)) for at in start]), *map(np.concatenate, cols))
        return
    for a, row, offset in _candidates(kernel, shorts, longs, lengths):
        if first is not None:
            later = row >= a + first
            a, row, offset = a[later], row[later], offset[later]
        done = []
        for low in range(0, len(a), max(1, CELLS // n)):
            x, r, o = (c[low : low + max(1, CELLS // n)] for c in (a, row, offset))
            good, keys, cols = kernel.exact(shorts[x], np.lib.stride_tricks.sliding_window_view(longs, n, axis=1)[r, o])
            done.append([c[good] for c in (x, r, o, *cols, *keys)])
        if done:
            x, r, o, *more = (np.concatenate(c) for c in zip(*done))
            cols, keys = more[: len(more) - len(keys)], more[len(more) - len(keys) :]
            if kernel.slide:
                at = _first_of_each(x * len(longs) + r, *keys, o)
                x, r, o, cols = x[at], r[at], o[at], [c[at] for c in cols]
            yield (x, r, *cols, o) if kernel.offset else (x, r, *cols)


def _padded(lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Series, a row each, filled up with zeros."""
    grid = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = flat
    return grid


def _pack(lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
    """(copies, lengths, values, codes) of sorted series, each run of copies once."""
    grid = _padded(lengths, flat)
    new = np.flatnonzero(np.concatenate([[True], (lengths[1:] != lengths[:-1]) | (grid[1:] != grid[:-1]).any(axis=1)]))
    kept = grid[new][np.arange(grid.shape[1]) < lengths[new, None]]
    values, codes = np.unique(kept, return_inverse=True)
    if len(values) > 1 << 16:
        values, codes = values[:0], kept
    codes = codes.astype("u1" if 0 < len(values) <= 256 else "<u2" if len(values) else "<i8")
    return np.diff(np.append(new, len(lengths))), lengths[new], values.astype("<i8").tobytes(), zlib.compress(codes.tobytes(), 1)


def _unpacked(lengths: np.ndarray, v: bytes, z: bytes) -> np.ndarray:
    """The packed series, a row each."""
    values, codes = np.frombuffer(v, dtype="<i8"), zlib.decompress(z)
    flat = values[np.frombuffer(codes, dtype="u1" if len(values) <= 256 else "<u2")] if len(values) else np.frombuffer(codes, dtype="<i8")
    return _padded(lengths, flat).view(np.uint64)


def _copies(a: np.ndarray, b: np.ndarray, many: np.ndarray, many2: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, k): each copy of a[k] with each of b[k], by their places in the two blocks, in pieces; same: of one block, whose copies meet each other once."""
    at, at2 = np.cumsum(many) - many, np.cumsum(many2) - many2
    ends = np.cumsum(many[a] * many2[b])
    starts = ends - many[a] * many2[b]
    for low in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
        high = min(low + ROWS, int(ends[-1]))
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        ks = np.arange(first, last)
        k = np.repeat(ks, np.minimum(ends[ks], high) - np.maximum(starts[ks], low))
        x, y = np.divmod(np.arange(low, high) - starts[k], many2[b[k]])
        x, y = at[a[k]] + x, at2[b[k]] + y
        if same:
            good = (a[k] != b[k]) | (x < y)
            x, y, k = x[good], y[good], k[good]
        yield x, y, k


def _grids(start: int, stop: int, by_id: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | slice]]:
    """(left, right, those that count): places start to stop - 1 of a block, each with TILE places of another at a time, which come in the order of their ids; same: of one block, whose places meet later ones only.

    In this order the ids and results of the pairs repeat themselves at short distance, so what is written compresses well.
    """
    for low in range(0, len(by_id), TILE):
        right = by_id[low : low + TILE]
        for at in range(start, stop, ROWS // TILE):
            left = np.arange(at, min(at + ROWS // TILE, stop))
            yield left, right, (left[:, None] < right).ravel() if same else slice(None)


def meet(packed: DataFrame, parts: int) -> DataFrame:
    """(i, j, and of either block all columns, those of the second with a 2 behind) of each block i of 0 to parts - 1 and itself and each later one."""
    tasks = parts * (parts + 1) // 2
    tasks = max(1, min(tasks, max(8 * packed.sparkSession.sparkContext.defaultParallelism, tasks // 16)))
    # Both sides go to the task of their pair at once: a join on one block's number would send the other side twice.
    left = packed.withColumn("j", F.explode(F.sequence("i", F.lit(max(parts - 1, 0)).cast("long")))).repartition(tasks, "i", "j")
    right = packed.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in packed.columns if c != "i"])
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "j"))).repartition(tasks, "i", "j")
    return left.hint("merge").join(right, ["i", "j"])


def all_pairs(series: DataFrame, kernel: Kernel, columns: list[str], block: int | None = None) -> DataFrame:
    """(clip, source, *columns) for each pair of series that the kernel has a result for; clip is the shorter one, of equally long ones that with the lesser id.

    series: id, b (an array of 32- or 64-bit blocks as longs). Null or empty arrays are in no
    pair, a null block counts as 0, and a null id is an id. Every pair of different series is
    looked at, so the work grows with the square of their number; copies that are dealt to a
    block count once. ids are of a type that Arrow sorts (numbers, strings, times). block:
    series of a block; by default so many that what is sent stays small beside the work, and
    a block bounded.
    """
    spark, scratch = series.sparkSession, Scratch(series.sparkSession)
    kind = series.schema["id"].dataType
    name = kind.simpleString()
    slim = series.where(F.size("b") > 0).select("id", F.transform("b", lambda x: F.coalesce(x, F.lit(0)).cast("long")).alias("b"), F.size("b").alias("n"))
    ranked = scratch.save(global_rank(slim, [F.col("n").asc(), F.col("b").asc(), F.col("id").asc()], "r"), "ranked")
    count, longest = ranked.agg(F.count_if(F.lit(True)), F.coalesce(F.max("n"), F.lit(1))).first()
    if not block:
        block = max(1, min(8192, max(128, count // (32 if kernel.slide else 16)), CELLS // longest))
        if not kernel.slide:  # whole tiles, so that what repeats lies alike
            block -= block % (TILE if block >= TILE else min(block, 8))
    blocks = ranked.groupBy(F.floor((F.col("r") - 1) / block).alias("i")).agg(F.array_sort(F.collect_list(F.struct("r", "id", "b"))).alias("s"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            for k in range(batch.num_rows):
                i, ids, values = (batch.column(c).slice(k, 1) for c in ("i", "ids", "values"))
                rows = values.flatten()
                many, n, v, z = _pack(rows.value_lengths().to_numpy(zero_copy_only=False), rows.flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([i, ids, pa.array([many], ints), pa.array([n], ints), pa.array([v], pa.binary()), pa.array([z], pa.binary())], ["i", "ids", "many", "n", "v", "z"])

    packed = blocks.select("i", F.col("s.id").alias("ids"), F.col("s.b").alias("values")).mapInArrow(pack, f"i long, ids array<{name}>, many array<int>, n array<int>, v binary, z binary")
    packed = scratch.save(packed, "blocks")
    parts = -(-count // block)
    packs = ["ids", "many", "n", "v", "z"]

    def every(shorts, longs, many, many2, n, n2, at: int, stop: int, both: pa.Array, order: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        """The pairs of equally long series at to stop - 1 with all series of the other block."""
        found = np.zeros((len(columns), stop - at, len(longs)), dtype=np.int32)
        for a, row, *cols in _best(kernel, shorts[at:stop, : n[at]], longs, n2, at if same else None):
            found[:, a, row] = cols
        kind, kind2 = np.repeat(np.arange(len(many)), many), np.repeat(np.arange(len(many2)), many2)
        first, end = np.searchsorted(kind, [at, stop])
        order, order2 = order[: len(kind)], order[len(kind) :]
        for x, y, good in _grids(first, end, np.argsort(order2), same):
            turn = (n2[kind2[y]] == n[at]) & (order[x][:, None] > order2[y])
            left, right = x[:, None], y + len(kind)
            left, right = np.where(turn, right, left).ravel()[good], np.where(turn, left, right).ravel()[good]
            yield pa.RecordBatch.from_arrays([both.take(pa.array(left)), both.take(pa.array(right)), *[pa.array(c[:, kind2[y]][kind[x] - at].ravel()[good]) for c in found]], ["clip", "source", *columns])

    def pairs(i: int, j: int, ids: pa.Array, many, n, v, z, ids2: pa.Array, many2, n2, v2, z2) -> Iterator[pa.RecordBatch]:
        many, n, many2, n2 = (np.array(x) for x in (many, n, many2, n2))
        shorts, longs = _unpacked(n, v, z), _unpacked(n2, v2, z2)
        both = pa.concat_arrays([ids, ids2])
        order = pc.rank(both, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1], [True]]))  # equally long ones lie together
        for low, high in zip(cut, cut[1:]):
            for at in range(low, high, 128):
                if not kernel.slide:
                    yield from every(shorts, longs, many, many2, n, n2, int(at), int(min(at + 128, high)), both, order, i == j)
                    continue
                for a, row, *cols in _best(kernel, shorts[at : min(at + 128, high), : n[low]], longs, n2, int(at) if i == j else None):
                    for x, y, k in _copies(a + at, row, many, many2, i == j):
                        y = y + len(ids)
                        turn = (n2[row[k]] == n[low]) & (order[x] > order[y])
                        x, y = np.where(turn, y, x), np.where(turn, x, y)
                        yield pa.RecordBatch.from_arrays([both.take(pa.array(x)), both.take(pa.array(y)), *[pa.array(c[k].astype(np.int32)) for c in cols]], ["clip", "source", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                side = lambda more: (batch.column("ids" + more)[k].values, *[batch.column(c + more)[k].as_py() for c in packs[1:]])  # noqa: E731, B023
                yield from pairs(batch.column("i")[k].as_py(), batch.column("j")[k].as_py(), *side(""), *side("2"))

    return meet(packed, parts).mapInArrow(run, f"clip {name}, source {name}, " + ", ".join(f"{c} int" for c in columns))
