"""k-means with Elkan's bounds against plain rounds: ties, repeated rows, odd vectors, few vectors, clashing columns."""

import hashlib
import math

import numpy as np
import pytest

from kindred.llm.clustering import ClusterParams, cluster_vectors, fit_centroids, usable


def plain(rows, p=ClusterParams()):
    kept = [(i, [math.floor(p.scale * x) for x in v], v) for i, v in rows if v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{p.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[: p.k]
    c = [r[1] for r in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, m), j) for j, m in enumerate(c)) for _, v, _ in kept]
    for _ in range(p.rounds):
        near = assign()
        for j in range(len(c)):
            own = [v for (_, v, _), (_, k) in zip(kept, near) if k == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    near = assign()
    sums = [sum(d for d, k in near if k == j) for j in range(len(c))]
    return sorted(((i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _, _), (d, j) in zip(kept, near)), key=str)


def got(df, p=ClusterParams()):
    return sorted((tuple(r) for r in cluster_vectors(df, p).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("seed", [0, 2])
def test_plain_with_ties(spark, seed):
    """Vectors of few values, so that many are as near to one centroid as to another, and odd rows among them."""
    rng = np.random.default_rng(seed)
    step = [1.0, 0.5, 1 / 1024][seed]
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 64) * step * (rng.random(64) < 0.1)]) for i in range(400)]
    rows += [rows[3]] * 5 + [(3, rows[4][1]), (None, rows[5][1]), (900, None), (901, []), (902, [0.0] * 63), (903, [None] + [0.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63), (906, [-0.0] * 64), (907, [100_000.0] * 64), (908, [-100_000.5] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as was", "3 as label", "4 as order_").repartition(3)
    assert got(df) == plain(rows)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.5, 2.0]), (3, [9.0])], "vec_id int, embedding array<double>")
    p = ClusterParams(dim=2)
    assert got(df, p) == plain([(1, [1.0, 2.0]), (2, [1.5, 2.0])], p)
    assert got(df.limit(0), p) == [] and cluster_vectors(df.limit(0), p).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [1e300, 0.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert [r[0] for r in got(huge, p)] == [3]


def test_bounds_skip_distances(spark, data):
    """Clustered vectors: later rounds compute far fewer than k distances a vector, with the same result."""
    rng = np.random.default_rng(0)
    middle = rng.normal(0, 1, (8, 64))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 8] + rng.normal(0, 0.1, 64)]) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    work = []
    fit_centroids(df.where(usable("embedding")), work=work)
    assert work[0] == 8 * 800 and work[-1] < 2 * 800
    assert got(df) == plain(rows)
