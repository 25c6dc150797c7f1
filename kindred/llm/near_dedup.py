"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct n-word shingles. Its signature has `symbols` minima of
b = 16 bits each; the distance of two signatures is the number of symbols that differ.
By the pigeonhole principle, if at most `max_distance` symbols differ, then in a split into
m1 + m0 chunks with 2*m1 + m0 = max_distance + 1 some of the m1 chunks has one differing
symbol at most, or some of the m0 chunks has none. So each document is filed under every
chunk with each single symbol left out (m1 chunks: all allowed errors enumerated) or whole
(m0 chunks), and any two documents within the distance share a key: none is missed.

A key's members are not paired with each other. First each is compared with one leader of
each of its keys, the nearest of them by full sets, and confirmed links contract, so a large
group of copies costs about its size; of the pairs whose ends are then in two components,
the nearest of any two components is confirmed in turn. Then, for each key whose members are still in several components, the members outside
its main component are compared with its others in blocks of bounded size: first by
signatures alone (a pair only in the first key that both have), then, with the texts of those that have a partner left in their block, by
full sets; only a spanning forest of the links leaves a block. So no link between components
is lost and no list of pairs is written.

At the default 24 of 64, a pair with similarity exactly 0.8 exceeds the signature distance
with a probability of about 0.0003, one with 0.85 of 0.000001.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kindred.llm.text import Words, shingle_set, slices
from kindred.operators.graph import connected_components
from kindred.plans.scratch import Scratch

_U32 = np.uint32
#: A Python worker keeps so many bytes of shingle sets that it may need again.
_HELD_BYTES = 64 << 20
#: Members of one side of a block of a key, about.
BLOCK = 1000


@dataclass(frozen=True)
class NearParams:
    """words: of a shingle; a link takes den * intersection >= num * union; see the module for symbols and max_distance."""

    words: int = 5
    num: int = 80
    den: int = 100
    symbols: int = 64
    max_distance: int = 24


def chunks(symbols: int, max_distance: int) -> list[tuple[int, int, int]]:
    """(first symbol, symbols, allowed errors) of each chunk; allowed errors + 1 add up to max_distance + 1."""
    ones, zeros = max_distance // 2, (max_distance + 1) - 2 * (max_distance // 2)
    g = (symbols - ones) // (ones + zeros)
    if g < 1:
        raise ValueError("too few symbols for this distance")
    out, at = [], 0
    for i in range(ones + zeros):
        n = g + (i < ones)
        out.append((at, n, int(i < ones)))
        at += n
    return out


def _sketch(p: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.random.default_rng(97).integers(0, 1 << 31, p.symbols, dtype=np.uint32) * _U32(2) + _U32(1)
        for batch in batches:
            for part, texts in slices(batch):
                hashes, bound = Words(texts).shingles(p.words)
                full = np.flatnonzero(np.diff(bound) > 0)
                sig = np.zeros((len(texts), p.symbols), dtype="<u2")
                if len(full):
                    x, cut = (hashes >> np.uint64(32)).astype(np.uint32), bound[:-1][full]
                    for j in range(p.symbols):
                        v = x * factor[j]
                        v ^= v >> _U32(15)
                        sig[full, j] = (np.minimum.reduceat(v, cut) * _U32(0x9E3779B1)) >> _U32(16)
                n, key = [], []
                for i in range(len(texts)):
                    own = np.unique(hashes[bound[i] : bound[i + 1]])
                    n.append(len(own))
                    key.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array([s.tobytes() if k else None for s, k in zip(sig, key)], pa.binary())],
                    ["doc_id", "n_shingles", "set_hash", "sig"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(t or b"", 1) for t in texts], pa.large_binary())], ["doc_id", "z"])


def _within(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
                b = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
                far = (a != b).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far, pa.int64())], ["a", "b", "far"]).filter(pa.array(far <= limit))

    return run


class _Sets:
    """Shingle sets of packed texts; the latest are held, up to a bound in bytes."""

    def __init__(self, p: NearParams):
        self.p, self.held, self.room = p, {}, 0

    def of(self, z: bytes) -> np.ndarray:
        got = self.held.get(z)
        if got is None:
            if self.room > _HELD_BYTES:
                self.held.clear()
                self.room = 0
            got = self.held[z] = shingle_set(zlib.decompress(z), self.p.words)
            self.room += got.nbytes + len(z)
        return got

    def linked(self, za: bytes, zb: bytes) -> bool:
        x, y = self.of(za), self.of(zb)
        small, large = (x, y) if len(x) < len(y) else (y, x)
        if not len(small) or self.p.den * len(small) < self.p.num * len(large):
            return False
        common = int((large[np.searchsorted(large[:-1], small)] == small).sum())
        return self.p.den * common >= self.p.num * (len(x) + len(y) - common)


def _confirm(p: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(p)
        for batch in batches:
            keep = [sets.linked(za, zb) for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of rows sorted by (key, i, j), one after the other."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack([np.array(batch.column(c)) for c in ("key", "i", "j")])
        if left and (np.array([left[-1].column(c)[-1].as_py() for c in ("key", "i", "j")]) != at[0]).any():
            yield pa.Table.from_batches(left)
            left = []
        cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            left.append(batch.slice(lo, hi - lo))
            if hi < len(at):
                yield pa.Table.from_batches(left)
                left = []
    if left:
        yield pa.Table.from_batches(left)


class _Block:
    """side 0: members outside the key's main component; side 1: all members."""

    def __init__(self, table: pa.Table, p: NearParams):
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(table.num_rows, -1)
        self.n, self.p = np.array(table.column("n")), p
        self.c = table.column("c").to_pylist()
        group = {c: k for k, c in enumerate(dict.fromkeys(self.c))}
        self.group = np.array([group[c] for c in self.c])
        self.turn = table.column("turn")[0].as_py()
        side = np.array(table.column("side"))
        self.inner, self.outer = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def near(self, i: int) -> np.ndarray:
        """The outer members that may be linked with i, are in another component, and whose first key in common with i is the block's."""
        o = self.outer[self.group[self.outer] != self.group[i]]
        o = o[self.p.den * np.minimum(self.n[o], self.n[i]) >= self.p.num * np.maximum(self.n[o], self.n[i])]
        differ = self.sig[o] != self.sig[i]
        few = differ.sum(axis=1) <= self.p.max_distance
        o, differ, base = o[few], differ[few], 0
        first = np.full(len(o), -1)
        for at, n, errors in chunks(self.p.symbols, self.p.max_distance):
            part = differ[:, at : at + n]
            ok = (first < 0) & (part.sum(axis=1) <= errors)
            first[ok] = base + (part[ok].argmax(axis=1) if errors else 0)
            base += n if errors else 1
        return o[first == self.turn]


def _screened(p: NearParams):
    """The members that have a near partner in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block, hit = _Block(table, p), np.zeros(table.num_rows, dtype=bool)
            for i in block.inner:
                near = block.near(i)
                if len(near):
                    hit[i] = True
                    hit[near] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _linked(p: NearParams, out: pa.Schema):
    """A spanning forest of the links between a block's components, as pairs of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(p)
        for table in _blocks(batches):
            block, found = _Block(table, p), []
            rep, z = table.column("rep").to_pylist(), table.column("z").to_pylist()
            up: dict[int, int] = {}

            def top(c: int) -> int:
                while up.get(c, c) != c:  # noqa: B023
                    up[c] = up.get(up[c], up[c])  # noqa: B023
                    c = up[c]  # noqa: B023
                return c

            for i in block.inner.tolist():
                for j in block.near(i).tolist():
                    a, b = top(int(block.group[i])), top(int(block.group[j]))
                    if a != b and sets.linked(z[i], z[j]):
                        up[max(a, b)] = min(a, b)
                        found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], out.field(k).type) for k in (0, 1)], schema=out)

    return run


def _pair_schema(pairs: DataFrame) -> pa.Schema:
    return to_arrow_schema(pairs.schema)


def _keys(reps: DataFrame, p: NearParams) -> DataFrame:
    each = []
    for c, (at, n, errors) in enumerate(chunks(p.symbols, p.max_distance)):
        cut = lambda i, k: F.substring("sig", 2 * i + 1, 2 * k)
        if not errors:
            each.append(F.xxhash64(F.lit(c), cut(at, n)))
        else:
            each += [F.xxhash64(F.lit(c), F.lit(j), cut(at, j), cut(at + j + 1, n - j - 1)) for j in range(n)]
    return reps.select("rep", F.posexplode(F.array(*each)).alias("turn", "key"))


def near_duplicates(docs: DataFrame, params: NearParams = NearParams(), scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (set size), component_id, kept.

    docs needs doc_id and text; other columns are not read, whatever their names. A null or
    blank text has an empty set and is linked with nothing. Rows that repeat an id with the
    same text are one node; with other texts, each text may link the id. A null id is
    compared with nothing: component_id is null and kept is true. An empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    p = params
    slim = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = scratch.save(slim.mapInArrow(_sketch(p), f"doc_id {kind}, n_shingles long, set_hash binary, sig binary"), "sketch")
    nodes = sketch.where("doc_id is not null and n_shingles > 0")
    grouped = nodes.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count_if(F.lit(True)).alias("n"), F.max("doc_id").alias("last"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    groups = scratch.save(grouped, "groups")
    reps = groups.select("rep", "sig", F.col("size").alias("n")).distinct()
    copies = nodes.join(groups.where("last <> rep").select("set_hash", "rep"), "set_hash").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keys = _keys(reps, p)
    shared = keys.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key")
    active = scratch.save(keys.join(shared, "key").distinct(), "active")
    deal = F.xxhash64("key", "rep")
    heads = active.groupBy("key").agg(F.min_by("rep", deal).alias("head"))
    pairs = active.join(heads, "key").where("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    sig = lambda s: reps.select(F.col("rep").alias(s), F.col("sig").alias(f"sig_{s}"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_within(p.max_distance), f"a {kind}, b {kind}, far long")
    near = scratch.save(near.groupBy("a", "b").agg(F.min("far").alias("far")), "near")
    ids = active.select(F.col("rep").alias("doc_id")).distinct()
    packed = slim.where("doc_id is not null").mapInArrow(_packed, f"doc_id {kind}, z binary").join(ids, "doc_id", "left_semi").distinct()
    packed = scratch.save(packed, "texts")
    z = lambda s: packed.select(F.col("doc_id").alias(s), F.col("z").alias(f"z{s}"))
    # The nearest partner of each document first: most other pairs are then within one component and need no look at the texts.
    ends = near.select(F.col("a").alias("v"), "a", "b", "far").union(near.select(F.col("b").alias("v"), "a", "b", "far"))
    best = ends.groupBy("v").agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    links = best.join(z("a"), "a").join(z("b"), "b").select("a", "b", "za", "zb").mapInArrow(_confirm(p), f"a {kind}, b {kind}")
    links = scratch.save(links.distinct(), "links")
    label = connected_components(links, "a", "b", scratch)
    # The other near pairs with a leader, as far as they would join what isn't joined yet: one of any two components.
    of = lambda s: label.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    apart = near.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
    apart = apart.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b")
    more = apart.join(z("a"), "a").join(z("b"), "b").select("a", "b", "za", "zb").mapInArrow(_confirm(p), f"a {kind}, b {kind}")
    links = links.union(scratch.save(more, "links"))
    label = connected_components(links, "a", "b", scratch)

    placed = scratch.save(active.join(label, F.col("rep") == F.col("node"), "left").select("key", "turn", "rep", F.coalesce("component", "rep").alias("c")), "placed")
    parts = placed.groupBy("key", "c").agg(F.count_if(F.lit(True)).alias("n"))
    parts = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("most")).where(F.col("all") > F.col("most.n"))
    parts = scratch.save(parts.select("key", F.col("most.c").alias("main"), F.ceil(F.col("all") / BLOCK).alias("outer_blocks"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("inner_blocks")), "parts")
    both = placed.join(parts, "key").withColumn("side", F.explode(F.when(F.col("c") != F.col("main"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    mine, theirs = F.when(F.col("side") == 0, F.col("inner_blocks")).otherwise(F.col("outer_blocks")), F.when(F.col("side") == 0, F.col("outer_blocks")).otherwise(F.col("inner_blocks"))
    both = both.withColumn("own", F.pmod(F.xxhash64("rep", "side"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)))
    first, second = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    both = both.select("key", "turn", first.alias("i"), second.alias("j"), "side", "rep", "c").join(reps, "rep").select("key", "turn", "i", "j", "side", "rep", "c", "sig", "n")
    in_blocks = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = scratch.save(in_blocks(both).mapInArrow(_screened(p), both.schema), "screened")
    made = in_blocks(near.join(packed.select(F.col("doc_id").alias("rep"), "z"), "rep")).select("key", "turn", "i", "j", "side", "rep", "c", "sig", "n", "z").mapInArrow(_linked(p, _pair_schema(links)), f"a {kind}, b {kind}")
    links = links.union(scratch.save(made.distinct(), "links"))
    label = connected_components(copies.union(links), "a", "b", scratch)
    out = sketch.join(label, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
