"""The chain on held-out documents, and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import toxicity


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_held_out(spark, sf, recall):
    """Fitted on documents of even ids only: of the odd ones' toxic labels this share is found, with hardly any false alarm."""
    docs, labels = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    even = F.col("doc_id") % 2 == 0
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.where(~even), toxicity.fit(docs.where(even), labels)).collect()}
    said = {r.doc_id: r for r in labels.where(~even).collect() if r.doc_id in got}
    found = [i for i in said if got[i].toxic]
    assert sum(said[i].toxic for i in found) >= recall * sum(r.toxic for r in said.values())
    assert sum(said[i].toxic for i in found) >= 0.9 * len(found)
    assert sum(not got[i].toxic for i, r in said.items() if not r.toxic) >= 0.98 * sum(not r.toxic for r in said.values())
    assert sum(got[i].low_quality == (r.quality == 0) for i, r in said.items()) >= 0.85 * len(said)


def test_earlier_categories_feed_later_ones():
    """A second category that is the first one's outcome, in texts whose words say nothing else of it, is had through the link."""
    rng = np.random.default_rng(0)
    lists, y = [], []
    for _ in range(600):
        first = rng.random() < 0.5
        lists.append(np.unique(np.append(rng.integers(100, 4000, 20), rng.integers(0, 30, 3) if first else rng.integers(30, 60, 3))))
        y.append([float(first), float(first), np.nan if rng.random() < 0.1 else float(first)])
    chain = toxicity.fit_chain(lists, np.array(y), ("a", "b", "c"))
    assert chain.link[1, 0] > 0.3 and chain.link[2, 0] > 0.3 and chain.link[2, 1] > 0.3
    assert not chain.link[np.triu_indices(3)].any()
    flat = toxicity._flat(lists)
    p = chain.probabilities(*flat)
    off = toxicity.Chain(chain.names, chain.weights, chain.bias, chain.link * 0).probabilities(*flat)
    assert np.allclose(p[:, 0], off[:, 0]) and np.abs(p[:, 2] - off[:, 2]).max() > 0.05
    assert ((p > 0.5) == (np.nan_to_num(np.array(y), nan=2) > 0.5))[:, :2].mean() > 0.97


def test_odd_rows(spark):
    texts = [(i, f"bad awful {i}" if i % 3 else f"fine good {i}") for i in range(90)] + [(None, "bad"), (1000, None), (1001, ""), (1002, " ,.;"), (1003, "bad awful " * 50_000), (5, "bad awful 5"), (5, "something else")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as y", "2 as l_id", "3 as toxic")
    rows = [(i, i % 2, int(i % 3 > 0)) for i in range(90)] + [(4, None, None), (None, 1, 1), (7, 1, 1), (7, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert len(got) == len(texts) and by[1003].toxic and by[None].toxic and not by[0].toxic and by[1].toxic
    assert all(by[i].p_toxic == by[i].p_low_quality == 0 and not by[i].toxic for i in (1000, 1001, 1002))
    for l in (labels.where("false"), labels.where("toxic = 1")):
        assert toxicity.fit(docs, l) is None
    assert toxicity.fit(docs.where("false"), labels) is None
    assert toxicity.score_toxicity(docs, None).where("toxic or p_toxic > 0").count() == 0
    assert toxicity.score_toxicity(docs.where("false"), None).count() == 0
