"""Series against series in blocks, against plain loops, and how much of the work is left to the exact kernels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import series as X


def alignments(kernel, series, score):
    """{(clip, source): best} by looking at every alignment of every pair."""
    out = {}
    order = sorted((len(b), i) for i, b in series.items() if b)
    for at, (n, clip) in enumerate(order):
        for m, source in order[at + 1 :]:
            found = [score(series[clip], series[source][o : o + n], o) for o in range(m - n + 1 if kernel.slide else 1)]
            found = [f for f in found if f is not None]
            if found:
                out[clip, source] = min(found)[1]
    return out


def hamming(s, w, o):
    bits = sum((x ^ y).bit_count() for x, y in zip(s, w))
    return ((bits, o), (bits, o)) if bits * 100 <= len(s) * 32 * 30 else None


def runs(s, w, o):
    match = run = best = gap = miss = 0
    for x, y in zip(s, w):
        if miss > -(-len(s) * X.MISS_BUDGET // 1):
            break
        if (x ^ y).bit_count() <= 9:
            match, run, gap = match + 1, run + 1, 0
            best = max(best, run)
        else:
            miss += 1
            run, gap = (run + 1, gap + 1) if gap < 1 else (0, 0)
    return ((-match, -best, o), (match, best, o)) if match * 12 >= len(s) * 6 else None


def prefix(s, w, o):
    return 0, (sum((x ^ y).bit_count() for x, y in zip(s, w)), len(s))


@pytest.mark.parametrize("values", [3, 1000])
def test_blocks_equal_plain_loops(spark, values):
    """With few values, by matrix products, and with many; in blocks of 7, and all in one."""
    rnd = random.Random(values)
    pool = [rnd.getrandbits(32) for _ in range(values)]
    base = [rnd.choice(pool) for _ in range(14)]
    series = {i: [b if rnd.random() < 0.8 else rnd.choice(pool) for b in base[rnd.randrange(3) :][: rnd.randrange(0, 12)]] for i in range(40)}
    df = spark.createDataFrame([*series.items(), (99, None)], "id long, b array<long>")
    for kernel, score, columns in [(X.hamming_window(70), hamming, ["bits", "pos"]), (X.tolerant_runs(9, 1, (6, 12)), runs, ["match", "run", "pos"]), (X.prefix_bits(), prefix, ["bits", "n"])]:
        want = alignments(kernel, series, score)
        for block in (7, None):
            got = X.all_pairs(df, kernel, columns, block).collect()
            assert want and len(got) == len(want) and {tuple(r)[:2]: tuple(r)[2:] for r in got} == want


def test_matrix_products_in_pieces(monkeypatch):
    """Long series are cut by offsets, and the best of all pieces counts."""
    rnd = np.random.default_rng(3)
    longs = rnd.integers(0, 3, (5, 90)).astype(np.uint64) * np.uint64(0xFFFF)
    shorts = longs[:4, 20:60].copy()
    best = lambda: sorted(zip(*[np.concatenate(c).tolist() for c in zip(*X._best(X.hamming_window(70), shorts, longs, np.full(5, 90), None))]))
    whole = best()
    monkeypatch.setattr(X, "CELLS", 1000)
    assert best() == whole and {(0, 0, 0, 20), (3, 3, 0, 20)} <= set(whole)


def test_few_alignments_are_left_to_the_exact_kernel():
    """Of series of five values only the alignments that give a result are looked at place by place."""
    rnd = np.random.default_rng(4)
    longs = np.array([0, 0xFFFF, 0xFF00FF, 0xF0F0F0F0, 0x0F0F0F0F], dtype=np.uint64)[rnd.integers(0, 5, (200, 70))]
    left = sum(len(a) for a, *_ in X._candidates(X.tolerant_runs(9, 1, (6, 12)), longs[:50, :50].copy(), longs, np.full(200, 70)))
    assert 50 <= left < 0.01 * 50 * 200 * 21


@pytest.mark.parametrize("block", [7, None])
def test_copies(spark, block):
    """Copies of series, in one block and over several: every pair of them, the lesser id first, as by plain loops; a null id is the least."""
    rnd = random.Random(8)
    pool = [[rnd.choice([0, 0xFFFF, 0xFF00FF]) for _ in range(rnd.randrange(1, 6))] for _ in range(12)]
    ids = rnd.sample(range(-500, 500), 60)
    series = {i: pool[k % len(pool)] if k % 3 else pool[0] for k, i in enumerate(ids)}
    df = spark.createDataFrame([*series.items()], "id long, b array<long>")
    nulled = spark.createDataFrame([(None if i == min(ids) else i, b) for i, b in series.items()], df.schema)
    for kernel, score, columns in [(X.hamming_window(70), hamming, ["bits", "pos"]), (X.tolerant_runs(9, 1, (6, 12)), runs, ["match", "run", "pos"]), (X.prefix_bits(), prefix, ["bits", "n"])]:
        want = alignments(kernel, series, score)
        got = X.all_pairs(df, kernel, columns, block).collect()
        assert len(got) == len(want) and {tuple(r)[:2]: tuple(r)[2:] for r in got} == want
        least = {tuple(min(ids) if x is None else x for x in r[:2]): tuple(r)[2:] for r in X.all_pairs(nulled, kernel, columns, block).collect()}
        assert least == want


def test_copies_are_packed_once_and_met_in_pieces(monkeypatch):
    """A run of copies is one series of a block, and pairs of copies are handed on in bounded pieces."""
    flat = np.array([5, 6] * 40 + [7, -1] * 2)
    many, n, v, z = X._pack(np.full(42, 2), flat)
    assert many.tolist() == [40, 2] and X._unpacked(n, v, z).view(np.int64).tolist() == [[5, 6], [7, -1]]
    monkeypatch.setattr(X, "ROWS", 50)
    pieces = list(X._copies(np.array([0, 0, 1]), np.array([0, 1, 1]), many, many, True))
    assert max(len(x) for x, *_ in pieces) <= 50
    pairs = [(x, y, k) for p in pieces for x, y, k in zip(*map(np.ndarray.tolist, p))]
    assert sorted(pairs) == sorted((x, y, 0 if y < 40 else 1 if x < 40 else 2) for x in range(42) for y in range(x + 1, 42))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_every_pair_in_grids(spark, monkeypatch, kind):
    """All pairs once, by tiles: blocks of several tiles, copies, null ids and equally long series whose ids are in another order than they lie."""
    monkeypatch.setattr(X, "TILE", 16)
    monkeypatch.setattr(X, "ROWS", 64)
    rnd = random.Random(8)
    some = [[rnd.getrandbits(32) for _ in range(rnd.randrange(1, 5))] for _ in range(30)]
    series = {i * 37 % 101: rnd.choice(some) for i in range(101)}
    df = spark.createDataFrame([(None if i == 5 else i, b) for i, b in series.items()], "id long, b array<long>").selectExpr(f"cast(id as {kind}) as id", "b")
    rank = lambda i: (i is not None, i)
    value = lambda i: None if i == 5 else str(i) if kind == "string" else i
    order = sorted(((len(b), rank(value(i))), value(i), b) for i, b in series.items())
    want = [(c, s, prefix(x, y, 0)[1]) for k, (_, c, x) in enumerate(order) for _, s, y in order[k + 1 :]]
    for block in (40, 7, None):
        got = X.all_pairs(df, X.prefix_bits(), ["bits", "n"], block).collect()
        assert sorted(map(repr, ((r.clip, r.source, (r.bits, r.n)) for r in got))) == sorted(map(repr, want))


def test_every_pair_takes_little_disk(spark, tmp_path):
    """4,032 series, 16 of each kind: what is written of their pairs is well below a byte each."""
    df = spark.range(4032).selectExpr("id", "transform(sequence(1, 20 + id % 252 % 5), k -> xxhash64(id % 252, k) & 65535) as b")
    X.all_pairs(df, X.prefix_bits(), ["bits", "n"]).selectExpr("least(clip, source) as a", "greatest(clip, source) as b", "bits / n as sim").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 4032 * 4031 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4032 * 4031 // 2


def test_alike_rounds_halves_up(spark):
    """All shares of up to 200 places, by exact fractions."""
    got = spark.range(1, 201).selectExpr("cast(id as int) as n", "explode(sequence(0, cast(id as int) * 32, 7)) as bits").select("n", "bits", X.alike(F.col("bits"), F.col("n")).alias("sim")).collect()
    assert len(got) > 90_000 and all(r.sim == ((2 * 10**9 * (32 * r.n - r.bits) + 32 * r.n) // (64 * r.n)) / 1e9 for r in got)
    assert max(abs(r.sim - (1 - r.bits / (r.n * 32.0))) for r in got) <= 5.1e-10
