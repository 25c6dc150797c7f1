"""Removal of repeated strings of WINDOW bytes, by a sparse suffix sort.

Which bytes go: every byte of a WINDOW-byte string that also starts anywhere else. Sorting
all suffixes would move hundreds of bytes for each byte of text, so suffixes are taken at
anchors only (see anchors.py): equal windows share an anchor at the same offset.

1. Screen: anchors whose K-byte string occurs once, by its hash, are dropped. Hashes decide
   nothing else; a clash only lets an anchor through.
2. The contexts of the other anchors are sorted as suffixes (from the anchor on, then the
   bytes before it, backwards). Each task sorts runs in memory. Contexts that are equal in
   all bytes within a run have all their windows repeated; one of them stands for them from
   there on, so a common passage's copies cost about their number of runs. Runs are
   front-coded (length of the prefix shared with the string before, and the rest), cut at
   splitters and exchanged.
3. A tree of losers merges each range, comparing strings only from the prefix that both are
   known to share with the last winner. The shared prefixes decide: contexts whose merged
   neighbours share K bytes form a group; where two of them share a bytes to the right of
   the anchor's string and b to the left, all windows with at most a to the right and b to
   the left are repeated. Joining the group's parts from the longest shared prefix to the
   shortest, each in order of the bytes to the left, meets for each context the best b for
   every a, without looking at all pairs.
4. A group that a splitter cuts (a passage in more contexts than a range holds) is decided
   as far as its range goes, and its windows are sorted and merged once more as strings of
   their own, of which equal neighbours are repeated.

No step gathers an anchor's occurrences in one task: counts are pre-aggregated, and ranges are
balanced by splitters on whole strings.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import SIDE, WINDOW, K, anchors
from kindred.llm.text import slices
from kindred.plans.scratch import Scratch

_PAD = 0xFF  # in no UTF-8 text
_FULL = WINDOW + SIDE
#: A place of an anchor: its text (by its MD5), where it is, and the first and last window that chose it.
_ID = np.dtype([("rid", "V16"), ("p", "<i4"), ("e1", "<i4"), ("e2", "<i4")])
#: What a string of a run is: one that stands for several whose result is known; one to decide on; one of the next range.
KNOWN, OWN, BEYOND = 0, 1, 2
_FOUND = "rid binary, p int, e1 int, e2 int, s binary"
_NAMES = ["rid", "p", "e1", "e2", "s"]


@dataclass(frozen=True)
class SortParams:
    """run: strings that a task sorts at once; range: strings of a merged range, about; most: ranges of one exchange (larger ranges are cut again, each by an exchange of its own); sample: strings a range that splitters are taken from."""

    run: int = 16_384
    range: int = 50_000
    most: int = 2_000
    sample: int = 32


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            texts = [t or b"" for t in texts]
            start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1].astype(np.int64)
            a = anchors(texts, start, np.frombuffer(b"".join(texts), dtype=np.uint8))
            rid = part.column("rid").take(pa.array(a["text"]))
            yield pa.RecordBatch.from_arrays([pa.array(a["h"].view(np.int64)), rid, *[pa.array(a[k].astype(np.int32)) for k in ("p", "e1", "e2")]], ["h", "rid", "p", "e1", "e2"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([zlib.compress(t or b"", 1) for t in texts], pa.binary())], ["rid", "z"])


def _mismatch(a: bytes, b: bytes, known: int) -> int:
    """The length of the prefix that equally long strings share, of which `known` bytes are known."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def _shared(strings: list[bytes]) -> np.ndarray:
    """The prefix that each of equally long strings shares with the one before."""
    grid = np.frombuffer(b"".join(strings), dtype=np.uint8).reshape(len(strings), -1)
    differ = grid[1:] != grid[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), grid.shape[1])])


def front_code(strings: list[bytes], ids: bytes, kinds: list[int]) -> bytes:
    """Sorted strings of equal length as shared prefix lengths and rests. ids: those of _ID, one each."""
    lcp = _shared(strings).astype("<u2")
    rest = b"".join(s[k:] for s, k in zip(strings, lcp.tolist()))
    return zlib.compress(np.array([len(strings), len(strings[0])], dtype="<u4").tobytes() + lcp.tobytes() + bytes(kinds) + ids + rest, 1)


def decode(blob: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(string, prefix shared with the one before, kind, id) in order."""
    raw, width = zlib.decompress(blob), _ID.itemsize
    n, size = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    lcp = np.frombuffer(raw, dtype="<u2", count=n, offset=8).tolist()
    at = 8 + 2 * n
    kinds, ids, at = raw[at : at + n], at + n, at + (1 + width) * n
    last = b""
    for i, k in enumerate(lcp):
        last = last[:k] + raw[at : at + size - k]
        at += size - k
        yield last, k, kinds[i], raw[ids + width * i : ids + width * (i + 1)]


class LoserTree:
    """Merges front-coded runs. share[r]: the prefix that run r's next string has in common with the last string given out."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.item = [next(r, None) for r in runs]
        self.share = [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.loser = [-1] * self.size
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            run = node - self.size
            return run if run < len(self.runs) else -1
        winner, other = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = other
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        if b < 0 or self.item[b] is None:
            return a, b
        if a < 0 or self.item[a] is None:
            return b, a
        x, y = self.share[a], self.share[b]
        if x != y:  # the longer a string agrees with the last one given out, the smaller it is
            return (a, b) if x > y else (b, a)
        s, t = self.item[a][0], self.item[b][0]
        k = _mismatch(s, t, x)
        if k == len(s) or s[k] < t[k]:
            self.share[b] = k
            return a, b
        self.share[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        """(string, prefix shared with the string given out before, kind, id)."""
        while self.top >= 0 and self.item[self.top] is not None:
            run = self.top
            s, _, kind, key = self.item[run]
            yield s, self.share[run], kind, key
            self.item[run] = item = next(self.runs[run], None)
            if item is not None:
                self.share[run] = item[1]
            node, winner = (self.size + run) >> 1, run
            while node:
                winner, self.loser[node] = self._play(winner, self.loser[node])
                node >>= 1
            self.top = winner


def cut_run(rows: list[tuple[bytes, int, bytes]], splitters: list[bytes], need: int) -> tuple[bytes, list[tuple[int, bytes, int]]]:
    """From (string, kind, id): ids of strings to decide on that occur again in the run, and (range, front-coded part, strings) of each range.

    A range's part ends with the strings beyond it that share `need` bytes with its splitter:
    others can be no partner of the range's strings.
    """
    rows.sort()
    first = np.flatnonzero(_shared([s for s, *_ in rows]) < len(rows[0][0]))
    size = np.diff(np.append(first, len(rows)))
    known = b"".join(rows[k][2] for i, n in zip(first[size > 1].tolist(), size[size > 1].tolist()) for k in range(i, i + n) if rows[k][1] == OWN)
    left = [rows[i] if n == 1 or rows[i][1] == BEYOND else (rows[i][0], KNOWN, rows[i][2]) for i, n in zip(first.tolist(), size.tolist())]
    strings = [s for s, *_ in left]
    at = [0, *[bisect.bisect_left(strings, x) for x in splitters], len(left)]
    parts = []
    for dest in range(len(splitters) + 1):
        a, b = at[dest], at[dest + 1]
        lo = a - 1 if a and strings[a - 1][:need] == splitters[dest - 1][:need] else a
        hi = b + 1 if b < len(left) and strings[b][:need] == splitters[dest][:need] else b
        if lo < hi:
            kinds = [left[i][1] if a <= i < b else BEYOND for i in range(lo, hi)]
            parts.append((dest, front_code(strings[lo:hi], b"".join(x[2] for x in left[lo:hi]), kinds), hi - lo))
    return known, parts


def _runs(strings, splitters: list[bytes], need: int, most: int):
    """strings: from a batch, (string, kind, id) one after the other. Rows with a negative dest, one of many, hold the ids that a run decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, bytes]] = []

        def flush() -> pa.RecordBatch:
            known, parts = cut_run(rows, splitters, need)
            rows.clear()
            parts += [(-1 - zlib.crc32(known) % 997, known, 0)] if known else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in parts], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.int32()))], ["dest", "blob", "n"])

        for batch in batches:
            for row in strings(batch):
                rows.append(row)
                if len(rows) >= most:
                    yield flush()
        if rows:
            yield flush()

    return run


def _contexts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bytes]]:
    """The anchor's K bytes, SIDE bytes after, SIDE bytes before (backwards), padded where the text ends."""
    pad = bytes([_PAD])
    for rid, z, refs in zip(batch.column("rid").to_pylist(), batch.column("z").to_pylist(), batch.column("refs").to_pylist()):
        t = zlib.decompress(z)
        for r in refs:
            p = r["p"]
            right, left = t[p : p + WINDOW], t[max(0, p - SIDE) : p][::-1]
            s = right + pad * (WINDOW - len(right)) + left + pad * (SIDE - len(left))
            yield s, OWN, np.array((rid, p, r["e1"], r["e2"]), dtype=_ID).tobytes()


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bytes]]:
    """The windows of a context: the anchor's string, what is after and before it (backwards), and how much is before. A null rid: of known result."""
    for rid, p, e1, e2, s in zip(*[batch.column(c).to_pylist() for c in _NAMES]):
        for e in range(e1, e2 + 1):
            n = p - e  # bytes before the anchor
            yield s[: WINDOW - n] + s[WINDOW : WINDOW + n] + bytes([n]), KNOWN if rid is None else OWN, np.array((rid or bytes(16), p, e, e), dtype=_ID).tobytes()


def repeated(strings: list[bytes], share: list[int]) -> list[list[tuple[int, int]]]:
    """For sorted contexts of one anchor string (share: the prefix in common with the one before): (least, most) bytes before the anchor of repeated windows."""
    n = len(strings)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def pair(i: int, j: int, right: int) -> None:
        left = _mismatch(strings[i][WINDOW:], strings[j][WINDOW:], 0)
        if left + right >= SIDE:
            out[i].append((SIDE - right, left))
            out[j].append((SIDE - right, left))

    if n == 2:
        pair(0, 1, min(share[1], WINDOW) - K)
        return out
    part: list[list[tuple[bytes, int]]] = [[(s[WINDOW:], i)] for i, s in enumerate(strings)]
    up = list(range(n))
    for k in sorted(range(1, n), key=lambda k: -min(share[k], WINDOW)):
        right = min(share[k], WINDOW) - K
        a, b = k - 1, k
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if len(part[a]) < len(part[b]):
            a, b = b, a
        large = part[a]
        for x in part[b]:
            at = bisect.bisect_left(large, x)
            if at:
                pair(large[at - 1][1], x[1], right)
            if at < len(large):
                pair(large[at][1], x[1], right)
            large.insert(at, x)
        part[b], up[b] = [], a
    return out


def _merge(table: pa.Table) -> pa.Table:
    """Repeated runs of windows (s null), and of cut groups the contexts whose windows are to be sorted."""
    out: list[tuple] = []
    group: list[tuple[bytes, int, int, bytes]] = []
    if (known := _known(table)) is not None:
        return pa.table([_rids(known), *[pa.array(np.ascontiguousarray(known[c])) for c in _NAMES[1:4]], pa.nulls(len(known), pa.binary())], names=_NAMES)

    def decide() -> None:
        if len(group) > 1:
            spans = repeated([g[0] for g in group], [g[1] for g in group])
            cut = any(g[2] == BEYOND for g in group)
            for i, (s, share, kind, key) in enumerate(group):
                if kind == BEYOND:
                    continue
                rid, p, e1, e2 = np.frombuffer(key, dtype=_ID)[0].tolist() if kind == OWN else (None, SIDE, 0, SIDE)
                if kind == OWN:
                    out.extend((rid, p, max(e1, p - b), min(e2, p - a), None) for a, b in spans[i] if max(e1, p - b) <= min(e2, p - a))
                if cut:  # what is shared with either neighbour bounds what any other shares to the right
                    most = max(share if i else 0, group[i + 1][1] if i + 1 < len(group) else 0)
                    e2 = min(e2, p - (SIDE - (min(most, WINDOW) - K)))
                    if e1 <= e2:
                        out.append((rid, p, e1, e2, s))
        group.clear()

    for s, share, kind, key in LoserTree([decode(b) for b in table.column("blob").to_pylist()]):
        if share < K:
            decide()
        if share == len(s) and group and s == group[-1][0]:
            # Equal in all bytes: both have every window repeated; one stands for them.
            for k in (group[-1][2:], (kind, key)):
                if k[0] == OWN:
                    rid, p, e1, e2 = np.frombuffer(k[1], dtype=_ID)[0].tolist()
                    out.append((rid, p, e1, e2, None))
            group[-1] = (s, group[-1][1], KNOWN if BEYOND not in (kind, group[-1][2]) else BEYOND, key)
        else:
            group.append((s, share, kind, key))
    decide()
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(zip(_NAMES, kinds))})


def _equal(table: pa.Table) -> pa.Table:
    """The ids of merged strings that equal a neighbour."""
    out, last = [], None
    if (known := _known(table)) is not None:
        return _spans(known.tobytes())
    for s, share, kind, key in LoserTree([decode(b) for b in table.column("blob").to_pylist()]):
        same = last is not None and share == len(s)
        if same:
            out += [k for x, k in (last, (kind, key)) if x == OWN]
        last = (KNOWN if same else kind, key)
    return _spans(b"".join(out))


def _spans(ids: bytes) -> pa.Table:
    rows = np.frombuffer(ids, dtype=_ID)
    return pa.table([_rids(rows), *[pa.array(np.ascontiguousarray(rows[k])) for k in ("e1", "e2")]], names=["rid", "e1", "e2"])


def _rids(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(rows["rid"].tobytes())]).cast(pa.binary())


def _known(table: pa.Table) -> np.ndarray | None:
    """The ids that runs decided, if that is what the table holds."""
    return np.frombuffer(b"".join(table.column("blob").to_pylist()), dtype=_ID) if table.column("dest")[0].as_py() < 0 else None


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bytes]]:
    """The strings of front-coded parts."""
    for blob in batch.column("blob").to_pylist():
        for s, _, kind, key in decode(blob):
            yield s, kind, key


def _sampled(strings, one_in: float):
    """A share of the strings, at equal distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = one_in / 2
            got = []
            for s, *_ in strings(batch):
                step += 1
                if step >= one_in:
                    step -= one_in
                    got.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["s"])

    return run


def _splitters(sample: list[bytes], parts: int) -> list[bytes]:
    """Strings that cut the sorted order into about equal parts, as short as they can be: of the places between sampled strings."""
    out, got = [], sorted(set(sample))
    for i in sorted({len(got) * i // parts for i in range(1, parts)} - {0}):
        k = next((k for k, (x, y) in enumerate(zip(got[i - 1], got[i])) if x != y), 0)
        out.append(got[i][: k + 1])
    return out


@dataclass(frozen=True)
class _Sort:
    """A merge sort of strings. merge: a merged range's result, of the given schema; picked and share: rows that hold the given share of all strings, to sample from."""

    scratch: Scratch
    p: SortParams
    need: int
    merge: Callable[[pa.Table], pa.Table]
    schema: str

    def run(self, source: DataFrame, strings, n: int, picked: DataFrame | None = None, share: float = 1.0) -> list[DataFrame]:
        """The results of the ranges and what runs decide, in parts to be put together; n: strings of source."""
        parts = min(self.p.most, -(-n // self.p.range))
        sample = (source if picked is None else picked).mapInArrow(_sampled(strings, max(1.0, n * share / (self.p.sample * parts))), "s binary").collect() if parts > 1 else []
        splitters, merge = _splitters([bytes(r["s"]) for r in sample], parts), self.merge
        runs = source.mapInArrow(_runs(strings, splitters, self.need, self.p.run), "dest int, blob binary, n int")
        merged = lambda df: self.scratch.save(df.select("dest", "blob").groupBy("dest").applyInArrow(lambda table: merge(table), self.schema), "merged")
        if parts < self.p.most:
            return [merged(runs)]
        # As many ranges as one exchange has: those that hold far more strings than a range should are cut again.
        runs = self.scratch.save(runs, "runs", "dest")
        size = {r["dest"]: r["n"] for r in runs.where("dest >= 0").groupBy("dest").agg(F.sum("n").alias("n")).collect()}
        # Strings that are equal can't be cut apart: a range that holds all there is is merged as it is.
        large = [d for d, k in size.items() if len(size) > 1 and k > 8 * self.p.range]
        out = [merged(runs.where(~F.col("dest").isin(large)) if large else runs)]
        for d in large:
            out += self.run(runs.where(F.col("dest") == d), _coded, size[d])
        self.scratch.drop(runs)
        return out


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist()):
                t = np.frombuffer(zlib.decompress(z), dtype=np.uint8)
                step = np.zeros(len(t) + 1, dtype=np.int64)
                for s in spans:
                    step[s["e1"]] += 1
                    step[s["e2"] + WINDOW] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.concatenate([[False], gone[:-1]])
                rest = t[~gone].tobytes()
                out.append((int(gone.sum()), int((gone & ~edge).sum()), hashlib.sha256(rest).hexdigest(), rest if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *[pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]], ["rid", "removed", "spans", "sha", "kept"])

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, params: SortParams = SortParams()) -> tuple[DataFrame, DataFrame]:
    """(rid, e1, e2): runs of first places of windows that are repeated, between texts or in one, for texts that have any, and (rid, z): those texts and some more, compressed; rid is the MD5 of the text.

    Equal texts are one here: what repeats because a whole text is there twice is for the caller to see.
    """
    one = F.count_if(F.lit(True))
    rows = docs.where("octet_length(text) > 0").select(F.unhex(F.md5("text")).alias("rid"), "text")
    found = scratch.save(rows.mapInArrow(_anchor_rows, "h long, rid binary, p int, e1 int, e2 int"), "anchors")
    again = scratch.save(found.groupBy("h").agg(one.alias("n")).where("n > 1").select("h"), "again")  # saved, so that the adaptive skew join may split a hot string
    # A set: all copies of a text have the same places.
    refs = scratch.save(found.join(again, "h").groupBy("rid").agg(F.collect_set(F.struct("p", "e1", "e2")).alias("refs")), "refs")
    scratch.drop(found, again)
    text = scratch.save(rows.mapInArrow(_packed, "rid binary, z binary").dropDuplicates(["rid"]).join(refs, "rid"), "texts")
    scratch.drop(refs)
    n = text.agg(F.sum(F.size("refs")).alias("n")).first()["n"] or 0
    # A sample for the splitters comes from as many texts as hold about 16 times its size.
    share = min(1.0, 16 * params.sample / params.range)
    picked = text.where(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(1_000_000)) < 1_000_000 * share)
    found = _Sort(scratch, params, K, _merge, _FOUND).run(text, _contexts, n, picked, share)
    found = scratch.save(_all(found), "found") if len(found) > 1 else found[0]
    out, asked = [found.where("s is null").select("rid", "e1", "e2")], found.where("s is not null")
    m = asked.agg(F.sum(F.col("e2") - F.col("e1") + 1).alias("n")).first()["n"] or 0
    if m:
        out += _Sort(scratch, params, WINDOW + 1, _equal, "rid binary, e1 int, e2 int").run(asked, _windows, m)
    return _all(out), text.select("rid", "z")


def remove_repeats(docs: DataFrame, texts: bool = False, scratch: Scratch | None = None, params: SortParams = SortParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts=True also kept (the remaining bytes).

    docs needs doc_id and text; other columns are not read. A null or empty text has 0 bytes
    and nothing removed. Rows that repeat count as places of their own, whatever their ids, so
    a text of WINDOW bytes or more that is there twice goes whole; such texts are sorted once,
    for their parts in other texts. A null doc_id is a row like others. Texts shorter than
    WINDOW bytes keep all. An empty table gives none. Removal works on bytes and may cut a
    character: kept is binary.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    rid = F.unhex(F.md5("text"))
    copied = rows.where(F.octet_length("text") >= WINDOW).groupBy(rid.alias("rid")).agg(F.count_if(F.lit(True)).alias("n")).where("n > 1").select("rid")
    copied = scratch.save(copied, "copied")
    spans, packed = repeated_spans(rows, scratch, params)
    spans = spans.join(copied, "rid", "left_anti").groupBy("rid").agg(F.collect_list(F.struct("e1", "e2")).alias("spans"))
    cut = packed.join(spans, "rid").mapInArrow(_cut(texts), "rid binary, removed long, spans long, sha string, kept binary").withColumn("gone", F.lit(False))
    nothing = F.lit("")
    cut = cut.union(copied.select("rid", F.lit(None).cast("long"), F.lit(1).cast("long"), F.sha2(nothing, 256), nothing.cast("binary"), F.lit(True)))
    if not texts:
        cut = cut.drop("kept")
    text = F.coalesce("text", nothing)
    base = rows.select("doc_id", rid.alias("id_"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), *([text.cast("binary").alias("all_")] if texts else []))
    out = base.join(cut, F.col("id_") == F.col("rid"), "left")
    kept = [F.coalesce("kept", "all_").alias("kept")] if texts else []
    removed = F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0)))
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), *kept)
