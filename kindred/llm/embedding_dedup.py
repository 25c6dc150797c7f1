"""Near-duplicate vectors by product quantisation.

Unit vectors are filed in the inverted list of their nearest coarse centroid, with the codes
of their residual in each of SUBSPACES subspaces and the length of what the codes leave out.
Each vector also visits its nearest `probes` lists. Where the sample has too few vectors for
as many centroids as the table needs, residuals have centroids of their own, the same for all
lists, and each list is parted by them (a vector visits the nearest `fine_probes` parts of
each list), so that lists keep their size as the table grows. In a list, distances from a visitor to
coded members are sums of table entries (asymmetric: the visitor is not coded). A member is
reranked by its exact cosine in double precision unless its table distance exceeds the
threshold's distance by more than what its own code leaves out: by the triangle inequality
that loses no link. What may be lost is only a pair neither of whose vectors visits the
other's list; recall is measured in the tests.

Equal vectors count as one with a weight. Lists are cut into blocks of bounded size, which
meet pairwise; a block gives numbers of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.graph import connected_components
from kindred.plans.scratch import Scratch


@dataclass(frozen=True)
class PQParams:
    """sample: vectors that the index is fitted on, at most; list_size: members of a list, about; most_lists: coarse centroids, at most; probes: lists that each vector visits; fine_probes: parts of each that it visits; block: rows of a block."""

    cosine: float = 0.95
    sample: int = 16_384
    list_size: int = 256
    most_lists: int = 4096
    probes: int = 12
    fine_probes: int = 4
    subspaces: int = 8
    codewords: int = 32
    block: int = 1024


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray  # lists x dim
    fine: np.ndarray  # parts of a list x dim, about its centroid
    codebook: np.ndarray  # subspaces x codewords x dim / subspaces


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        count = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin((c * c).sum(axis=1) - 2 * x[i : i + 4096] @ c.T, axis=1)
    return out


def fit_index(vectors: np.ndarray, total: int, p: PQParams) -> Index:
    """Centroids and codebooks from a sample of unit vectors; the number of lists and of their parts follows the number of all vectors."""
    rng, dim = np.random.default_rng(11), vectors.shape[1]
    lists = int(max(1, min(p.most_lists, total // p.list_size, len(vectors) // 4 or 1)))
    coarse = _kmeans(vectors, lists, rng)
    rest = vectors - coarse[_nearest(vectors, coarse)]
    pieces = int(max(1, min(total // (p.list_size * lists), len(vectors) // 4))) if lists == p.most_lists else 1
    fine = _kmeans(rest, pieces, rng) if pieces > 1 else np.zeros((1, dim))
    rest = rest - fine[_nearest(rest, fine)]
    parts = p.subspaces if dim % p.subspaces == 0 else 1
    sub = rest.reshape(len(rest), parts, dim // parts)
    words = min(p.codewords, len(vectors))
    return Index(coarse, fine, np.stack([_kmeans(np.ascontiguousarray(sub[:, j]), words, rng) for j in range(parts)]))


def _codes(rest: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the length of what they leave out."""
    parts, _, width = book.shape
    sub = rest.reshape(len(rest), parts, width)
    code = np.stack([_nearest(np.ascontiguousarray(sub[:, j]), book[j]) for j in range(parts)], axis=1)
    made = np.concatenate([book[j][code[:, j]] for j in range(parts)], axis=1)
    return code.astype(np.uint8), np.sqrt(((rest - made) ** 2).sum(axis=1))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the unit vector (little-endian doubles; null for vectors that link with nothing)."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], dtype="<f8") if v else np.zeros(0)
            n = 0.0
            if np.isfinite(x).all() and x.any():
                # Squares of very large or small components leave the range of doubles.
                x = x / 2.0 ** np.floor(np.log2(np.abs(x).max()))
                n = float(np.sqrt((x * x).sum()))
            out.append((x / n).tobytes() if n > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "u"])


def _ranked(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, in order."""
    far, n = (c * c).sum(axis=1) - 2 * x @ c.T, min(n, len(c))
    near = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1), axis=1)


def _file(index: Index, p: PQParams):
    """One row for each list that a vector visits: l, home, visits, side 0 (a member of the list) or 1 (a visitor only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = index.coarse
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.frombuffer(b"".join(part.column("u").to_pylist()), dtype="<f8").reshape(part.num_rows, -1)
                near = _ranked(x, c, p.probes)
                if len(index.fine) > 1:
                    rest = (x[:, None, :] - c[near]).reshape(-1, x.shape[1])
                    part_of = _ranked(rest, index.fine, p.fine_probes)
                    near = (np.repeat(near.ravel(), part_of.shape[1]).reshape(part_of.shape) * len(index.fine) + part_of).reshape(len(x), -1)
                n = near.shape[1]
                row = np.repeat(np.arange(part.num_rows), n)
                table = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [table.column("rep"), table.column("w"), table.column("u"), pa.array(near.ravel().astype(np.int32)), pa.array(np.repeat(near[:, 0], n).astype(np.int32)), pa.array([near[i].astype("<i4").tobytes() for i in row], pa.binary())],
                    ["rep", "w", "u", "l", "home", "visits"],
                )

    return run


def _match(index: Index, p: PQParams, out: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        rep, w = np.array(table.column("rep").to_pylist()), np.array(table.column("w").to_pylist())
        side, home, l = (np.array(table.column(c).to_pylist()) for c in ("side", "home", "l"))
        x = np.frombuffer(b"".join(table.column("u").to_pylist()), dtype="<f8").reshape(len(rep), -1)
        visits = np.frombuffer(b"".join(table.column("visits").to_pylist()), dtype="<i4").reshape(len(rep), -1)
        inner, outer = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, up = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        if len(inner) and len(outer):
            here = int(l[0])
            centre = index.coarse[here // len(index.fine)] + index.fine[here % len(index.fine)]
            code, left = _codes(x[inner] - centre, index.codebook)
            parts, _, width = index.codebook.shape
            reach = np.sqrt(2 - 2 * p.cosine) + left + 1e-9
            # A pair that both lists would find is counted in the lower one; within a list, by the lower id.
            for i in range(0, len(outer), 128):
                rows = outer[i : i + 128]
                sub = (x[rows] - centre).reshape(len(rows), parts, width)
                tables = ((sub[:, :, None, :] - index.codebook[None]) ** 2).sum(axis=3)
                far = sum(tables[:, j][:, code[:, j]] for j in range(parts))
                a, b = np.nonzero(np.sqrt(far) <= reach[None])
                a, b = rows[a], inner[b]
                own = home[a] == here
                both = (visits[b] == home[a][:, None]).any(axis=1)
                keep = np.where(own, rep[a] < rep[b], ~both | (here < home[a]))
                a, b = a[keep], b[keep]
                hit = np.einsum("ij,ij->i", x[a], x[b]) >= p.cosine
                a, b = a[hit], b[hit]
                np.add.at(links, a, w[b])
                np.add.at(links, b, w[a])
                for s, t in zip(a.tolist(), b.tolist()):
                    while up[s] != s:
                        up[s] = s = up[up[s]]
                    while up[t] != t:
                        up[t] = t = up[up[t]]
                    if s != t:
                        up[max(s, t)] = min(s, t)
        some = np.flatnonzero(links)
        root = some.copy()
        for k in range(len(root)):
            while up[root[k]] != root[k]:
                root[k] = up[root[k]]
        return pa.Table.from_arrays([pa.array(rep[some].tolist(), out.field(0).type), pa.array(links[some], pa.int64()), pa.array(rep[root].tolist(), out.field(2).type)], schema=out)

    return run


def near_duplicate_vectors(vectors: DataFrame, params: PQParams = PQParams(), scratch: Scratch | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, as do rows with a null vec_id (component_id null, kept true). Vectors of
    different lengths are compared within their own length only. Rows with equal vectors
    link with each other and share all links. Only vec_id and embedding are read. An empty
    table gives none. No cap anywhere: all blocks of a list meet.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    spark, p = vectors.sparkSession, params
    kind = vectors.schema["vec_id"].dataType.simpleString()
    unit = scratch.save(vectors.select("vec_id", "embedding").mapInArrow(_unit, f"vec_id {kind}, u binary"), "unit")
    live = unit.where("vec_id is not null and u is not null")
    reps = scratch.save(live.groupBy("u").agg(F.min("vec_id").alias("rep"), F.count_if(F.lit(True)).alias("w")), "reps")
    lengths = {r["d"]: r["n"] for r in reps.groupBy(F.length("u").alias("d")).agg(F.count_if(F.lit(True)).alias("n")).collect()}
    # A length of one vector has nothing to compare; one of them is filed if there are no others, as the forest may not be missing.
    several = {d: n for d, n in lengths.items() if n > 1} or dict(sorted(lengths.items())[:1])
    forest, counts = None, None
    for d, n in sorted(several.items()):
        own = reps.where(F.length("u") == d)
        deal = F.pmod(F.xxhash64("u", F.lit(3)), F.lit(1 << 30))
        picked = own.where(deal < min(1.0, p.sample / n) * (1 << 30)).select("u").limit(2 * p.sample).collect()
        sample = np.stack(sorted((np.frombuffer(r["u"], dtype="<f8") for r in picked), key=lambda v: v.tobytes())) if picked else np.frombuffer(own.first()["u"], dtype="<f8")[None]
        index = fit_index(sample, n, p)
        filed = scratch.save(own.select("rep", "w", "u").mapInArrow(_file(index, p), f"rep {kind}, w long, u binary, l int, home int, visits binary"), "lists")
        sizes = filed.groupBy("l").agg(F.ceil(F.count_if(F.col("l") == F.col("home")) / p.block).alias("inner"), F.ceil(F.count_if(F.lit(True)) / p.block).alias("outer"))
        sides = filed.join(sizes, "l").where("inner > 0").withColumn("side", F.explode(F.when(F.col("l") == F.col("home"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
        mine, theirs = F.when(F.col("side") == 0, F.col("inner")).otherwise(F.col("outer")), F.when(F.col("side") == 0, F.col("outer")).otherwise(F.col("inner"))
        sides = sides.withColumn("own", F.pmod(F.xxhash64("rep"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)))
        sides = sides.withColumn("i", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
        schema = f"rep {kind}, links long, root {kind}"
        arrow = pa.schema([("rep", _arrow(filed)), ("links", pa.int64()), ("root", _arrow(filed))])
        made = scratch.save(sides.groupBy("l", "i", "j").applyInArrow(_match(index, p, arrow), schema), "links")
        forest = made if forest is None else forest.union(made)
    if forest is None:
        empty = unit.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        return empty
    label = connected_components(forest, "rep", "root", scratch)
    links = forest.groupBy("rep").agg(F.sum("links").alias("links"))
    info = reps.join(links, "rep", "left").join(label, F.col("rep") == F.col("node"), "left")
    info = info.select(F.col("u").alias("ru"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    # The vector may be a third of all rows: the small side is joined to the rows, which the skew join splits.
    out = unit.join(info, (F.col("u") == F.col("ru")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _arrow(filed: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(filed.schema["rep"].dataType)
