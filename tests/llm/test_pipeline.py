"""Every stage of the pipeline against a plain version on its own input."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixing import plain as plain_mix
from test_pii import base

import corpus_pipeline

ODD = [(9001, None, None, None), (9002, "", "en", "src1"), (9003, "12 34 !?", "de", None), (9004, "Это русский текст о погоде и природе, в нём нет ничего общего с другими", None, "src2"), (9005, "the and of to that is in for with on this by", None, "src1"), (9005, "the and of to that is in for with on this by", None, "src1"), (None, "la de que los para del las con una por", "es", "src1")]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """(name, rows in, rows out) of each stage, written and read between."""
    path = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(*r, 0) for r in ODD], docs.schema))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, data)
        assert done.columns == docs.columns + (["copy"] if name == "mixing" else [])
        done.write.parquet(f"{path}/{name}")
        done = spark.read.parquet(f"{path}/{name}")
        out[name] = (docs.collect(), done.collect())
        docs = done
    return out


def key(r):
    return (str(r.doc_id), str(r.text), str(r.source))


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def five(text):
    """Distinct five-word shingles, from plain strings."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]


def test_language(stages):
    """What has no letter or is in no learned language goes; all that is labelled stays, but for 1 in 100; a missing language is filled in."""
    before, after = stages["language_id"]
    kept = {r.doc_id for r in after}
    assert not kept & {9001, 9002, 9003, 9004} and {9005, None} <= kept
    clean = [r for r in before if r.lang and any(map(str.isalpha, r.text or ""))]
    assert sum(r.doc_id in kept for r in clean) >= 0.99 * len(clean)
    assert all(r.lang for r in after) and {r.lang for r in after if r.doc_id == 9005} == {"en"}
    same = {key(r): r for r in before}
    assert all(same[key(r)].lang in (None, r.lang) and same[key(r)].n_chars == r.n_chars for r in after)


def test_near(stages):
    """One document of each group of five-word shingles at 0.8, the one with the least id, null last."""
    before, after = stages["near_dedup"]
    order = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest())
    rows = sorted({(order(r), r.text) for r in before})
    sets = [five(t) for _, t in rows]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    want = [rows[i] for i in range(len(rows)) if top(i) == i]
    assert sorted((order(r), r.text) for r in after) == want and len(after) < len(before)


def test_rows_are_told_apart_by_id_and_text(spark, data):
    """An id of two texts, equal texts under ids and none: what is like nothing else stays, and one of each group."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight", "north south east west up down left right")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, b), (None, c), (None, c), (None, "short"), (7, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (None, "short"), (7, "")], key=str)


def test_leaks_without_id(spark, data):
    """A null id, and an id of two texts, of which one leaks."""
    item = max((r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if r.text), key=len)
    clean = "birds of the northern coast and how they spend the winter months far from home"
    rows = [(None, f"before it {item} after it"), (1, item), (1, clean), (None, clean), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    got = corpus_pipeline.drop_leaks(spark, docs, data).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, clean), (None, clean), (2, None)], key=str)


def subsequence(a, b):
    """The longest common subsequence, by the usual table."""
    row = np.zeros(len(b) + 1, dtype=int)
    b = np.array(b, dtype=object)
    for x in a:
        hit = np.concatenate([[0], row[:-1] + (b == x)])
        row = np.maximum.accumulate(np.maximum(row, hit))
    return row[-1]


def test_leaks(spark, data, stages):
    """Documents with a benchmark item in them go. Whatever goes has, in some window of an item's length and half as much again, three fifths of its words in order."""
    before, after = stages["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {key(r) for r in after}
    for r in before:
        said = words(r.text)
        line = " " + " ".join(said) + " "
        if any(x and f" {' '.join(x)} " in line for x in items):
            assert key(r) not in kept
        elif key(r) not in kept:
            def best(x):
                size = int(1.5 * len(x)) + 16
                return max(subsequence(x, said[k : k + size]) for k in range(0, max(1, len(said) - size + 1), max(1, len(x) // 4))) / len(x)
            assert max(best(x) for x in items if x) >= 0.6
    assert kept <= {key(r) for r in before} and len(after) < len(before)


def test_pii(stages):
    """No base span is left, texts without finds are as they were, and the length follows the text."""
    before, after = stages["pii"]
    old = {str(r.doc_id): r for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not [x for x in base(r.text) if x[3] != "card"] and r.n_chars == len(r.text)
        if not base(old[str(r.doc_id)].text) and "<" not in r.text:
            assert r.text == old[str(r.doc_id)].text
        assert (r.lang, r.source) == (old[str(r.doc_id)].lang, old[str(r.doc_id)].source)
    assert any("<EMAIL>" in r.text for r in after)


def test_mixing(stages):
    before, after = stages["mixing"]
    want = {str(i): taken // n if n else 0 for i, n, _, _, taken in plain_mix([(r.doc_id, r.text, r.source) for r in before])}
    got = dict.fromkeys(want, 0)
    for r in after:
        got[str(r.doc_id)] += 1
    some = {str(r.doc_id) for r in before if words(r.text)}
    assert sum(got[i] != want[i] for i in some) <= 2 and all(1 <= r.copy <= 3 for r in after)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count()


def test_stages_on_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0, name
