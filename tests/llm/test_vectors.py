"""Links of vectors against brute force, over many lists of which each vector visits a few."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import embedding_dedup
from kindred.llm.embedding_dedup import PQParams


def run(spark, vectors, params=PQParams()):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df.withColumn("l", F.lit(1)).withColumn("rep", F.lit("x")), params).collect()}


def close(rng, n, dim, copies):
    """n vectors with copies of cosines from 0.9 to 1, about, half of them in dense clusters."""
    centre = rng.standard_normal((8, dim))
    base = rng.standard_normal((n, dim)) + np.where(np.arange(n)[:, None] % 2, centre[rng.integers(0, 8, n)], 0)
    out = [base]
    for _ in range(copies):
        noise = rng.standard_normal((n, dim))
        noise -= base * (noise * base).sum(axis=1, keepdims=True) / (base * base).sum(axis=1, keepdims=True)
        noise *= np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
        out.append(base + noise * np.tan(np.arccos(rng.uniform(0.9, 1, n)))[:, None])
    return rng.permutation(np.concatenate(out))


@pytest.mark.parametrize(("params", "lists", "parts"), [(PQParams(list_size=20), 210, 1), (PQParams(list_size=4, most_lists=16), 16, 60)])
def test_recall(spark, params, lists, parts):
    """At least 0.9 of the links are found with lists that a vector visits one in seventeen of, and none is made up; so too where lists are parted."""
    x = close(np.random.default_rng(1), 1_400, 64, 2)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.fit_index(u, len(u), params)
    assert len(index.coarse) >= lists and len(index.fine) >= parts
    got = run(spark, x, params)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert true.sum() > 2_000 and (found <= true).all()
    assert found.sum() >= 0.9 * true.sum(), found.sum() / true.sum()


def test_one_list_loses_nothing(spark):
    """All lists visited: links and components are those of brute force."""
    x = close(np.random.default_rng(2), 100, 16, 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    got = run(spark, x, PQParams(list_size=40, block=64))
    label = np.arange(len(x))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert [got[i].n_links for i in range(len(x))] == (link.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [one, None, [], [0.0] * 4, [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0, 0, 0], [x * 1e200 for x in one], [x * 1e-200 for x in one], one, [1.0, 2.0], [2.0, 4.0], [-x for x in one], [7.0]]
    got = run(spark, rows)
    alike = {0, 7, 8, 9}
    assert {i for i in got if got[i].n_links == 3} == alike and {got[i].component_id for i in alike} == {0}
    assert got[10].n_links == got[11].n_links == 1 and got[11].component_id == 10 and not got[11].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1, 2, 3, 4, 5, 6, 12, 13))
    df = spark.createDataFrame([(1, one), (1, one), (None, one), (2, [9.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 0, "2", True), ("None", 0, "None", True)]
    assert embedding_dedup.near_duplicate_vectors(df.where("false")).count() == 0
    assert embedding_dedup.near_duplicate_vectors(df.where("vec_id is null")).count() == 1
