"""Repeated strings: the sort's parts against plain versions, and the whole against a count of all windows, with ranges so small that groups are cut and ranges are cut again."""

import hashlib

import numpy as np
import pytest

from kindred.llm import suffix_dedup
from kindred.llm.suffix_dedup import _FULL, _ID, K, KNOWN, OWN, SIDE, WINDOW, SortParams


def shared(a, b):
    return next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def brute(texts):
    """(bytes, removed, spans, hash of the rest) of each text."""
    count = {}
    for b in texts:
        for p in range(len(b) - WINDOW + 1):
            count[b[p : p + WINDOW]] = count.get(b[p : p + WINDOW], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - WINDOW + 1):
            if count[b[p : p + WINDOW]] > 1:
                gone[p : p + WINDOW] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(0)
    items = sorted({bytes(rng.integers(97, 99, 12, dtype=np.uint8)) for _ in range(400)})
    runs = [sorted(items[i::5]) for i in range(5)]
    coded = [suffix_dedup.front_code(r, b"".join(s.ljust(_ID.itemsize) for s in r), [OWN] * len(r)) for r in runs]
    out = list(suffix_dedup.LoserTree([suffix_dedup.decode(c) for c in coded]))
    assert [s for s, *_ in out] == items and [k[:12] for *_, k in out] == items
    assert [k for _, k, *_ in out][1:] == [shared(a, b) for a, b in zip(items, items[1:])]


def test_cut_runs_keep_partners_beyond_splitters():
    rows = [(x.encode(), OWN, bytes([i]) * _ID.itemsize) for i, x in enumerate(["aab", "aac", "aac", "abb", "bbb"])]
    known, parts = suffix_dedup.cut_run(rows, [b"aac", b"b"], 2)
    assert known == bytes([1]) * _ID.itemsize + bytes([2]) * _ID.itemsize
    got = {d: [(s, k) for s, _, k, _ in suffix_dedup.decode(b)] for d, b, _ in parts}
    assert got == {0: [(b"aab", OWN), (b"aac", suffix_dedup.BEYOND)], 1: [(b"aab", suffix_dedup.BEYOND), (b"aac", KNOWN), (b"abb", OWN)], 2: [(b"bbb", OWN)]}


@pytest.mark.parametrize("seed", range(20))
def test_group_decides_every_window(seed):
    """For contexts of one anchor's string: a window is repeated if and only if another has its bytes."""
    rng = np.random.default_rng(seed)
    some = [bytes(rng.integers(97, 100, SIDE, dtype=np.uint8)) for _ in range(4)]

    def side():
        x, y = some[rng.integers(4)], some[rng.integers(4)]
        k = int(rng.integers(0, SIDE + 1))
        return x[:k] + y[k:]

    strings = sorted({b"k" * K + side() + side() for _ in range(int(rng.integers(2, 60)))})
    got = suffix_dedup.repeated(strings, [0, *map(shared, strings, strings[1:])])
    for i, s in enumerate(strings):
        windows = {n for a, b in got[i] for n in range(a, b + 1)}
        cut = lambda x, n: (x[: WINDOW - n], x[WINDOW : WINDOW + n])
        assert windows == {n for n in range(SIDE + 1) if any(cut(s, n) == cut(t, n) for j, t in enumerate(strings) if j != i)}
    assert all(len(s) == _FULL for s in strings)


@pytest.mark.parametrize("params", [SortParams(), SortParams(run=400, range=200), SortParams(run=250, range=20, most=3)])
def test_whole(spark, params):
    """Passages around the least length, in many documents, with like and unlike surroundings; copies; repeats in a text; rows that repeat."""
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n))
    hot, short, just = word(120), word(400)[:399], word(400)[:400]
    left, right = word(30), word(30)
    texts = []
    for i in range(60):
        a, b = (left if i % 3 else word(30)), (right if i % 4 else word(30))
        texts.append(word(5) + a + hot + b[: 7 * (i % 9)] + word(5))
    for i in range(40):
        around = (word(3) + left[-i:] if i else word(3), right[: 100 - 2 * i] + word(4))
        texts.append(around[0] + just + around[1])
        texts.append(around[0] + short + word(20))
    texts += ["é" * 300, "ab" * 700, hot + word(10) + hot, None, "", "x" * 450, "x" * 399, left, word(100), *texts[:9], "ÿ" * 250]
    texts = [None if t is None else t for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] + [(None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as z", "1 as rid", "2 as refs")
    want = [(str(i), *x) for (i, _), x in zip(rows, brute([(t or "").encode() for _, t in rows]))]
    assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.remove_repeats(df, params=params).collect()) == sorted(want)
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(df.where("doc_id is not null"), texts=True, params=params).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() for i in kept)


def test_repeated_rows_cost_no_more_than_others(spark):
    """20,000 equal rows with null ids, and as many under ids, beside a text that shares a part of theirs."""
    text = "".join(chr(97 + c) for c in np.random.default_rng(2).integers(0, 26, 3000))
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text").union(spark.range(20_000).selectExpr("id", f"'z{text}' as text"))
    df = df.union(spark.createDataFrame([(-1, "a" * 10 + text[100:700] + "b" * 10)], "doc_id long, text string"))
    got = suffix_dedup.remove_repeats(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got)) == [(620, 600, 1, 1), (3000, 3000, 1, 20_000), (3001, 3001, 1, 20_000)]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    short = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r[:4]) for r in suffix_dedup.remove_repeats(short).collect()) == [(1, 1, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0)]
