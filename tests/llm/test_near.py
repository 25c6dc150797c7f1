"""Near-duplicates that chain, large groups, and odd rows."""

import random

from pyspark.sql import functions as F

from kindred.llm import near_dedup
from kindred.llm.near_dedup import NearParams


def run(spark, rows, params=NearParams()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    return {r.doc_id: r for r in near_dedup.near_duplicates(df, params).collect()}


def test_long_chain(spark):
    """10,000 documents, each like the next (0.84) and not like the one after: one component."""
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(10_000 * 8 + 100)]
    got = run(spark, [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(10_000)])
    assert len(got) == 10_000 and {r.component_id for r in got.values()} == {0} and sum(r.kept for r in got.values()) == 1


def test_large_groups(spark):
    """Thousands of near copies of one text, thousands that share half of it, exact copies, and pairs just below and above the threshold."""
    rnd = random.Random(2)
    word = lambda: f"v{rnd.randrange(10**8)}"
    base, half = [word() for _ in range(200)], [word() for _ in range(100)]
    rows = []
    for i in range(1_200):
        text = base[:]
        text[rnd.randrange(200)] = word()
        rows.append((i, " ".join(text)))
    rows += [(10_000 + i, " ".join(half + [word() for _ in range(60)])) for i in range(700)]
    rows += [(20_000 + i, "one two three four five six seven") for i in range(500)]
    pairs = {}
    for i in range(200):
        # 100 shingles; of the partner k are other ones: similarity (100 - k) / (100 + k).
        text, k = [word() for _ in range(104)], 9 + i % 5
        rows += [(30_000 + 2 * i, " ".join(text)), (30_001 + 2 * i, " ".join(text[: 104 - k] + [word() for _ in range(k)]))]
        pairs[i] = 100 * (100 - k) >= 80 * (100 + k)
    got = run(spark, rows)
    assert {got[i].component_id for i in range(1_200)} == {0}
    assert all(got[10_000 + i].component_id == 10_000 + i for i in range(700))
    assert {got[20_000 + i].component_id for i in range(500)} == {20_000}
    assert {i: got[30_001 + 2 * i].component_id == 30_000 + 2 * i for i in pairs} == pairs


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (6, "a b"), (None, "a"), (7, "x y z " * 5000), (7, "x y z " * 5000), (8, "X y z " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("c", F.lit(2)).withColumn("rep", F.lit("r"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("1", 0, "1", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 1, "4", True), ("5", 1, "4", False), ("6", 1, "6", True), ("7", 3, "7", True), ("7", 3, "7", True), ("8", 3, "7", False), ("None", 1, "None", True)]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0
