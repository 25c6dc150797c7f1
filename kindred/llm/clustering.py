"""k-means over integer vectors, exact to the last bit, with Elkan's bounds.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the
distance to each one. When centroids move, bounds move by as much; a centroid whose lower
bound, or half of whose distance from the vector's own centroid, is above the upper bound
can't be the nearest and is skipped. All bounds are rounded to the safe side and only strict
inequalities skip, so ties are seen; what is left is decided by integer distances. New
centroids come from running sums, which only the vectors that moved change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch

#: Up to this size of a component, squared distances of 64 components fit 63 bits.
LARGEST = 189_812_531
_SAFE = 2.0**-50


@dataclass(frozen=True)
class ClusterParams:
    """k centroids over vectors of dim components, each floor(scale * x); rounds of moving; seed of the first centroids."""

    k: int = 8
    dim: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: str = "3"


def usable(embedding: str | Column, p: ClusterParams = ClusterParams()) -> Column:
    """Whether a vector has p.dim components, all finite and small enough."""
    fine = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * p.scale < LARGEST), F.lit(False))
    return F.coalesce((F.size(embedding) == p.dim) & F.forall(embedding, fine), F.lit(False))


def whole_components(batch: pa.RecordBatch, p: ClusterParams) -> np.ndarray:
    """The vectors of a batch as integers, one a row."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * p.scale).astype(np.int64).reshape(-1, p.dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SAFE)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - _SAFE)


def _distances(c: np.ndarray) -> np.ndarray:
    """Squared distances between centroids."""
    return np.array([squared(c, row) for row in c])


_STATE = "vec_id {id}, embedding array<{x}>, cluster int, was int, upper double, lower array<double>, computed int"


def assign_all(p: ClusterParams, c: np.ndarray) -> Callable:
    """Every distance, exact: the first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_components(batch, p)
            d = np.stack([squared(x, row) for row in c], axis=1)
            best = d.argmin(axis=1)  # the smallest number among equals
            root = np.sqrt(d.astype(np.float64))
            yield _rows(batch, best, np.full(len(x), -1), _up(root[np.arange(len(x)), best]), _down(root), np.full(len(x), len(c)))

    return run


def assign_bounded(p: ClusterParams, c: np.ndarray, before: np.ndarray) -> Callable:
    """Move vectors to their nearest centroids c, with bounds kept for the centroids before."""
    moved = _up(np.sqrt(np.array([squared(a[None], b)[0] for a, b in zip(c, before)], dtype=np.float64)))
    half = _down(np.sqrt(_distances(c).astype(np.float64))) / 2
    np.fill_diagonal(half, np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(c)
            at = np.arange(n)
            own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            upper = _up(batch.column("upper").to_numpy(zero_copy_only=False) + moved[own])
            lower = _down(np.maximum(lower - moved, 0.0))
            count, best = np.zeros(n, dtype=np.int64), own.copy()
            open_ = (upper[:, None] >= lower) & (upper[:, None] >= half[own])
            open_[at, own] = False
            x = None
            rows = np.flatnonzero(open_.any(axis=1))
            if len(rows):
                x = whole_components(batch, p)
                least = np.zeros(n, dtype=np.int64)
                least[rows] = squared(x[rows], c[own[rows]])
                count[rows] += 1
                root = np.sqrt(least[rows].astype(np.float64))
                upper[rows], lower[rows, own[rows]] = _up(root), _down(root)
                open_ &= (upper[:, None] >= lower) & (upper[:, None] >= half[own])
                for j in range(k):
                    r = np.flatnonzero(open_[:, j] & (upper >= lower[:, j]))
                    if len(r):
                        d = squared(x[r], c[j])
                        count[r] += 1
                        root = np.sqrt(d.astype(np.float64))
                        lower[r, j] = _down(root)
                        nearer = (d < least[r]) | ((d == least[r]) & (j < best[r]))
                        m = r[nearer]
                        best[m], least[m], upper[m] = j, d[nearer], _up(root[nearer])
            yield _rows(batch, best, own, upper, lower, count)

    return run


def _rows(batch: pa.RecordBatch, best, was, upper, lower, count) -> pa.RecordBatch:
    k = lower.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(best) * k + 1, k, dtype=np.int32)), pa.array(lower.ravel()))
    cols = [batch.column("vec_id"), batch.column("embedding"), pa.array(best, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), lists, pa.array(count, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["vec_id", "embedding", "cluster", "was", "upper", "lower", "computed"])


def _changes(p: ClusterParams, k: int) -> Callable:
    """What vectors that moved add to and take from the sums of centroids, summed up per task; place p.dim is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, p.dim + 1), dtype=np.int64)
        for batch in batches:
            x = whole_components(batch, p)
            x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
            for name, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(name).to_numpy(zero_copy_only=False)
                for j in range(k):
                    total[j] += sign * x[of == j].sum(axis=0)
        j, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(d, pa.int32()), pa.array(total[j, d], pa.int64())], ["cluster", "place", "change"])

    return run


def _final(p: ClusterParams, c: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(squared(whole_components(batch, p), c[of]), pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def fit_centroids(vectors: DataFrame, p: ClusterParams = ClusterParams(), scratch: Scratch | None = None, work: list[int] | None = None) -> tuple[np.ndarray, DataFrame]:
    """(centroids, assignment) after p.rounds rounds and a last assignment. work: takes the number of exact distances of each round.

    vectors: vec_id and embedding, usable ones only. The driver holds k centroids and their sums, nothing else.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    named = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    picked = vectors.withColumn("order_", F.sha2(F.concat(F.lit(f"{p.seed}:"), named), 256)).orderBy("order_", "embedding").limit(p.k).select("embedding").collect()
    c = np.array([np.floor(np.array(r["embedding"], dtype=np.float64) * p.scale) for r in picked], dtype=np.int64).reshape(-1, p.dim)
    kinds = {f.name: f.dataType for f in vectors.schema}
    schema = _STATE.format(id=kinds["vec_id"].simpleString(), x=kinds["embedding"].elementType.simpleString())
    if not len(c):
        return c, vectors.sparkSession.createDataFrame([], schema)
    sums = [[0] * (p.dim + 1) for _ in c]
    state = scratch.save(vectors.mapInArrow(assign_all(p, c), schema), "bounds")
    for turn in range(p.rounds):
        if work is not None:
            work.append(state.agg(F.sum("computed").alias("n")).first()["n"])
        delta = state.where("cluster <> was").select("embedding", "cluster", "was").mapInArrow(_changes(p, len(c)), "cluster int, place int, change long")
        for r in delta.groupBy("cluster", "place").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect():
            sums[r["cluster"]][r["place"]] += int(r["change"])
        before, c = c, np.array([[v // s[-1] for v in s[:-1]] if s[-1] else row.tolist() for s, row in zip(sums, c)], dtype=np.int64)
        if (c == before).all():
            break  # all further rounds would be the same
        old, state = state, scratch.save(state.mapInArrow(assign_bounded(p, c, before), schema), "bounds")
        scratch.drop(old)
    return c, state


def cluster_vectors(vectors: DataFrame, p: ClusterParams = ClusterParams(), scratch: Scratch | None = None) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). The first centroids are the vectors with the least
    SHA-256 of "seed:vec_id"; each round assigns every vector to the nearest centroid (ties:
    the smaller number) and puts every centroid that has vectors at their floored mean.

    vectors needs vec_id and embedding; other columns are not read. Left out are vectors that
    are null, of another length, with null or non-finite components, or with components from
    LARGEST / scale (185,000) on, whose distances may not fit a long. A null vec_id counts as
    an empty one. Rows that repeat are vectors each; of vectors with equal ids, the one with
    the lesser components comes first among the first centroids. Fewer vectors than k make
    fewer centroids, and an empty table gives none. Inertias that don't fit a long are null.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    own = vectors.select("vec_id", "embedding").where(usable("embedding", p))
    c, state = fit_centroids(own, p, scratch)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    near = scratch.save(state.select("vec_id", "embedding", "cluster").mapInArrow(_final(p, c), f"vec_id {kind}, cluster int, distance long"), "assigned")
    scratch.drop(state)
    per = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(int(r["s"]) for r in per))
    rows = [(r["cluster"], fits(int(r["s"])), whole, hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    told = near.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(p: ClusterParams = ClusterParams()) -> str:
    """cluster_vectors(embeddings) in DuckDB's SQL: its own rounds, without bounds."""
    near = """
a{r} AS (SELECT vec_id, vid, CAST(arg_min(c, (d, c)) AS INT) AS c, min(d) AS d FROM (SELECT any_value(v.vec_id) AS vec_id, v.vid, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM v JOIN m{r} m ON v.i = m.i GROUP BY v.vid, m.c) GROUP BY vid, vec_id)"""
    move = """
s{n} AS (SELECT a.c, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} a USING (vid) GROUP BY a.c, v.i),
m{n} AS (SELECT m.c, m.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, m.x) AS x FROM m{r} m LEFT JOIN s{n} s ON s.c = m.c AND s.i = m.i)"""
    steps = ",".join(near.format(r=r) + "," + move.format(r=r, n=r + 1) for r in range(p.rounds)) + "," + near.format(r=p.rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS vid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {p.dim} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)) AND abs(CAST(x AS DOUBLE)) * {p.scale} < {LARGEST})) = {p.dim}
), v AS MATERIALIZED (
  SELECT vid, vec_id, unnest(range({p.dim})) AS i, CAST(floor({p.scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), first AS (
  SELECT vid, row_number() OVER (ORDER BY sha256('{p.seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS c FROM kept QUALIFY c < {p.k}
), m0 AS (SELECT first.c, v.i, v.x FROM v JOIN first USING (vid)),
{steps},
told AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{p.rounds} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{p.rounds} JOIN told USING (c)"""


CLUSTER_SQL = cluster_sql()
