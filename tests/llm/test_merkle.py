"""The Merkle manifest against a plain recursion: sizes round powers of the arity, nulls, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from kindred.llm import merkle
from kindred.llm.merkle import lower_some, manifest

A_TO_Z = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """(root, [(left, right) a level] of each leaf)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            p.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        level, at = [H("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [i // 16 for i in at]
    return level[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in names]
    trees = [tree([leaf(*r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (sub, paths), up in zip(groups, trees, above):
        for r, path in zip(g, paths):
            tampered = r if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else (r[0], r[1].translate(A_TO_Z), *r[2:])
            node = leaf(*tampered)
            for a, b in path + up:
                node = H(a + node + b)
            out.append((r[0], leaf(*r), sub, root, H("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=str)


def rows_of(sizes):
    rng = random.Random(1)
    text = lambda: rng.choice([None, "", "lower", "Some Ünder TEXT", "X" * rng.randrange(1, 50)])
    return [(rng.randrange(10**6), text(), rng.choice([None, "en"]), s, rng.choice([None, 0, 7])) for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {None: 1, "": 2, "ä": 257, "z": 256, "b c": 33}, {"big": 4100, None: 15}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_plain(spark, sizes):
    rows = rows_of(sizes)
    if len(sizes) > 2:
        rows += [rows[0]] * 20 + [(None, "No Id", "en", "z", 1), (None, None, None, "z", None), (rows[5][0], "Other", None, rows[5][3], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'t' as tree", "1 as idx", "2 as level", "3 as digest", "4 as n")
    assert sorted((tuple(r) for r in manifest(df, lower_some(df)).collect()), key=str) == plain(rows)


def test_untampered_and_empty(spark):
    df = spark.createDataFrame(rows_of({"a": 40, "b": 3}), SCHEMA)
    assert all(r.verified for r in manifest(df).collect())
    assert manifest(df.limit(0)).count() == 0


def test_partial_parents_wait_for_their_children():
    """Children dealt over two tasks: neither completes the cut parents; what is left of both does."""
    kinds = {"tree": pa.string(), "level": pa.int32(), "idx": pa.int64(), "n": pa.int64(), "data": pa.binary()}
    n = 300
    events = [("t", 0, i, n, bytes([i % 256]) * 32) for i in range(n)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))
    done = [r for part in (events[:100], events[100:]) for out in merkle.combine(iter([batch(part)])) for r in zip(*[c.to_pylist() for c in out.columns])]
    assert not [r for r in done if r[0] == merkle._ROOT]
    left = [r[1:] for r in done if r[0] == merkle._OPEN]
    assert 0 < len(left) < 60
    rest = [r for out in merkle.combine(iter([batch(left)])) for r in zip(*[c.to_pylist() for c in out.columns])]
    assert [r[5].hex() for r in rest if r[0] == merkle._ROOT] == [tree([e[4].hex() for e in events])[0]]
    assert len([r for r in done + rest if r[0] == merkle._LINK]) == 19 + 2 + 1
