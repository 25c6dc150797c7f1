"""Line dedup against a plain version: nulls, empty and long texts, ties of ids, repeated rows, clashing columns, and runs of several levels."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm.line_dedup import LineParams, LineRuns, dedup_lines, line_hashes
from kindred.plans.scratch import Scratch

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def plain(rows, chars=40, documents=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(A_TO_Z)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                held.setdefault(key(line), set()).add(i)
    top = {k: max(ids, key=lambda i: -1 if i is None else i) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if top.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(3)
    pool = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (39, 40, 41, 60, 200, 45, 52, 70)] + ["é" * 39, "é" * 40, "ß" * 20 + "Ä" * 21, "x" * 20 + "   " + "y" * 20]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(int(rng.integers(0, 9))):
            x = pool[min(int(rng.geometric(0.25)) - 1, len(pool) - 1)]
            x = x.upper() if rng.random() < 0.3 and x.isascii() else x
            lines.append([x, "  " + x, x + " \t\r\x0b\x0c", " " + x, ""][int(rng.integers(0, 5))])
        rows.append((int(i), "\n".join(lines)))
    return [*rows, rows[7], rows[7], (7, "other\n" + pool[3]), (None, pool[3] + "\n" + pool[4]), (None, pool[3]), (200, None), (201, ""), (202, "\n\n"), (203, "\n".join(pool * 300)), (204, "k" * 300_000)]


@pytest.mark.parametrize("params", [LineParams(), LineParams(batches=1), LineParams(batches=7, fanout=2), LineParams(batches=7, fanout=3), LineParams(chars=1, documents=1)])
def test_plain(spark, params):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as h", "1 as pos", "2 as top", "3 as gone", "4 as text_key")
    got = sorted((tuple(r) for r in dedup_lines(df, params).collect()), key=str)
    assert got == plain(rows, params.chars, params.documents)


def test_texts_and_empty(spark):
    rows = [(i, "a\n" + "b" * 50) for i in range(5)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert {r.doc_id: r.kept for r in got} == {**{i: "a" for i in range(4)}, 4: "a\n" + "b" * 50}
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.n_lines for r in dedup_lines(spark.createDataFrame([("x", None)], "doc_id string, text string")).collect()] == [1]


def test_runs_settle_and_level(spark):
    """Settled hashes are left out of later runs, levels hold less than fanout runs, and batches may come in any order."""
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('z', 50) || char(10) || repeat(char(97 + id % 7), 44) as text")
    lines = line_hashes(docs).withColumn("part", F.col("doc_id") % 6).cache()
    for order in (range(6), reversed(range(6))):
        runs = LineRuns(spark, Scratch(spark), LineParams())
        for i in order:
            runs.add(lines.where(F.col("part") == i))
            assert all(len(level) < 2 for level in runs.levels)
        most = spark.table(runs.levels[-1][0]).agg(F.max("n")).first()[0]
        got = {bytes(r.h): r.top for r in runs.frequent().collect()}
        assert got == {bytes(r.h): r.t for r in lines.groupBy("h").agg(F.max("doc_id").alias("t")).collect()} and 10 <= most <= 60
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
