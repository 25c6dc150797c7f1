"""Scan settings, decisions, identities and group sorts on hand-made rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kindred.functions.presets import history, presets
from kindred.operators import kernels as K
from kindred.operators import ranking as R
from kindred.plans import registry
from kindred.sources import store
from kindred.sources.eligibility import ScanSettings, comparable, scan_reasons, under


def test_under(spark):
    rows = spark.createDataFrame([("/a",), ("/a/b",), ("/a/.b",), ("/a/b/.c",), ("/ab",), (None,)], "f string")
    assert [r[0] for r in rows.select(under(F.col("f"), "/a")).collect()] == [True, True, False, True, False, None]


CATALOGUE = "path string, folder string, size_bytes long, flags int, is_image boolean, want string"


def test_every_reason_in_its_order(spark):
    rows = [
        ("/m/a.jpg", "/other", 1, 3, True, "images off"),
        ("/m/X/a.mkv", "/m/X", 1, 3, False, "excluded folder"),
        ("/m/tmp7/a.mkv", "/m/tmp7", 1, 3, None, "excluded folder"),
        ("/o/a.mkv", "/o", 1, 3, False, "not included"),
        ("/m/.h/a.mkv", "/m/.h", 1, 3, False, "not included"),
        (None, None, None, None, None, "not included"),
        ("/m/1.mkv", "/m", 1, 3, False, "manual"),
        ("/m/2.mkv", "/m", 1, 2, False, "too dark"),
        ("/m/gone.mkv", "/m", 1, 0, False, "missing"),
        (None, "/m", 1, 0, False, "missing"),
        ("/m/small.mkv", "/m", 1, 0, False, "size"),
        ("/m/null.mkv", "/m", None, None, False, "size"),
        ("/m/edge.txt", "/m", 10, 0, False, "lacks pattern"),
        ("/m/link9.mkv", "/m", 20, 0, False, "link"),
        ("/m/new\nline9.MKV", "/m", 20, 0, False, "has pattern"),
        ("/m/good.mkv", "/m", 15, None, None, None),
    ]
    broken = spark.range(1).select(F.concat(F.encode(F.lit("/m/a.mkv"), "UTF-8"), F.unhex(F.lit("EDA0BD"))).cast("string").alias("path"), F.lit("/m").alias("folder"), F.lit(1).cast("long").alias("size_bytes"), F.lit(0).alias("flags"), F.lit(False).alias("is_image"), F.lit("unsafe path").alias("want"))
    files = spark.createDataFrame(rows, CATALOGUE).union(broken)
    listing = files.where("path is not null and path not like '%gone%'").select("path", F.col("path").like("%link%").alias("is_link"))
    settings = ScanSettings(("/m",), excluded=("/M/x", "tmp*"), images=False, sizes=(10, 20), must_match=("*.mkv",), must_not_match=("*9.mkv",))
    got = scan_reasons(files, listing.union(listing), settings).collect()
    assert len(got) == len(rows) + 1 and [(r.path, r.reason) for r in got if r.reason != r.want] == []
    kind = ScanSettings(("/m",), missing_too=True, links_too=True)
    assert {r.want for r in scan_reasons(files, listing, kind).where("reason is null").collect()} >= {"missing", "size", "lacks pattern", "link", "has pattern", None}
    flat = ScanSettings(("/m",), below=False, missing_too=True)
    assert {r.path for r in scan_reasons(files, listing, flat).where("reason = 'not included'").collect()} == {"/m/a.jpg", "/m/X/a.mkv", "/m/tmp7/a.mkv", "/o/a.mkv", "/m/.h/a.mkv", None}
    assert scan_reasons(files.limit(0), listing.limit(0), settings).count() == 0


def test_comparable(spark):
    kind = "file_id long, is_image boolean, has_info boolean, invalid boolean, failed boolean"
    rows = [(1, False, True, False, False), (2, True, True, None, None), (3, False, True, False, False), (4, True, None, False, False), (5, True, True, True, False), (6, True, True, False, True), (7, None, True, False, False)]
    samples = spark.createDataFrame([(1,), (1,), (3,), (None,)], "file_id long")
    assert sorted(r.file_id for r in comparable(spark.createDataFrame(rows, kind), samples, 2).collect()) == [1, 2]


def test_video_decision(spark):
    rows = [
        ([[0, 0], [0, 0]], [[0, 0], [32, 32]], True, 0.0625),
        ([[0, 0], [0, 0]], [[0, 0], [33, 32]], False, None),
        ([[0, 0], [0, 0]], [[64, 64], [0, 0]], False, None),
        ([[0, 0]], [[0, 0], [0, 0]], False, None),
        ([None, [0, 0]], [[0, 0], [0, 0]], False, None),
        ([], [], False, None),
        (None, [[0, 0]], False, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "x array<array<int>>, y array<array<int>>").select(K.video_decision(F.col("x"), F.col("y"), 0.0625).alias("d"))
    assert [(r.d.dup, r.d.diff) for r in df.collect()] == [r[2:] for r in rows]


def test_hash_decision_and_flips(spark):
    df = spark.createDataFrame([(0, 63), (0, 127), (-1, None), (-1, -1)], "a long, b long").select(K.hash_decision(F.col("a"), F.col("b"), 0.9).alias("d"))
    assert [tuple(r.d) for r in df.collect()] == [(True, 6 / 64), (False, 7 / 64), (False, 1.0), (True, 0.0)]
    rows = [([0, 0], [-1], [0, 0, 5], "plain", 1.0), ([-1, -1], [0, 255], [0, 0], "flip", 1 - 4 / 64), ([-1], [-1], [0], None, None), ([], [0], [0], "flip", 1.0), ([0], [0], None, None, None), ([None, 0], [None], [0, 0], None, None)]
    df = spark.createDataFrame([r[:3] for r in rows], "a array<long>, f array<long>, b array<long>").select(K.match_or_flip(F.col("a"), F.col("f"), F.col("b"), 0.9).alias("m"))
    assert [tuple(r.m) if r.m else (None, None) for r in df.collect()] == [r[3:] for r in rows]


def members(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice(v)
    rows = [(pick("a", "b", None), i, pick(1, 2, None), *[pick(1, 2)] * 2, pick("x", None), "aac", "2", 44, pick(1, None), pick(float("nan"), 25.0), pick(True, False, None)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "group_id string, item_id long, size_bytes long, duration long, frame_size long, format string, audio_format string, audio_channel string, audio_rate long, bitrate long, fps double, checked boolean")


@pytest.mark.parametrize("identity", sorted(R.IDENTITIES))
def test_identical(spark, identity):
    rows, df = members(spark, 1)
    places = {c: i for i, c in enumerate(df.columns)}
    key = lambda r: tuple(str(r[places[c]]) for c in ("group_id", *R.IDENTITIES[identity]))
    want = {r[1]: n for r in rows if (n := sum(key(r) == key(o) for o in rows) - 1)}
    assert {r.item_id: r.n_same for r in R.identical(df, identity).collect()} == want


@pytest.mark.parametrize("key", ["size", "total", "checked"])
def test_group_order(spark, key):
    rows, df = members(spark, 2)
    for down in (False, True):
        got = R.group_order(df, key, down).collect()
        assert len(got) == len(rows) and [(r.v, r.group_id or "", r.item_id) for r in got] == sorted(((r.v, r.group_id or "", r.item_id) for r in got), key=lambda t: ((-t[0] if down else t[0]), *t[1:]))
        for r in got:
            mine = [o for o in rows if o[0] == r.group_id]
            assert r.v == {"size": len(mine), "total": sum(o[2] or 0 for o in mine), "checked": any(o[-1] for o in mine)}[key]


def test_sorts_keep_their_order_at_another_size(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet'")
    for name in ("ORD1_group_size_desc", "ORD1_group_total_asc"):
        cur = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert [tuple(r) for r in registry.QUERIES[name](spark, folder).select(*names).collect()] == cur.fetchall()


def test_presets_and_history(spark):
    log = [("u", "save", "big", "x > 1", 1), ("u", "save", "old", "x > 2", 2), ("u", "save", "big", "x > 3", 3), ("u", "delete", "old", None, 4), ("u", "save", " ", "x > 4", 5), ("u", "delete", "none", None, 6),
           ("u", "save", "old", "x > 1", 7), (None, "save", "big", "y", 8), (None, "delete", "big", None, 9), (None, "save", "z", "  ", 10), ("v", "rename", "a", "b", 11)]
    df = spark.createDataFrame(log, "owner string, action string, name string, expression string, t long")
    got = [(r.owner, r.name, r.expression, r.added.t) for r in presets(df, ["t"]).orderBy("owner", "added").collect()]
    assert got == [(None, "z", "  ", 10), ("u", "big", "x > 3", 1), ("u", "old", "x > 1", 7)]
    used = [(r.owner, r.expression) for r in history(df.where("action = 'save'"), ["t"]).orderBy("owner", F.desc("used")).collect()]
    assert used == [(None, "y"), ("u", "x > 1"), ("u", "x > 4"), ("u", "x > 3"), ("u", "x > 2")]
    assert presets(df.limit(0), ["t"]).count() == 0 and history(df.limit(0), ["t"]).count() == 0


def test_pair_text(spark):
    pairs = spark.createDataFrame([(1, 2, 1000, "AudioMatch", 3), (1, 9, 955, "FrameSimilarity", None)], "file_a long, file_b long, sim long, method string, clip_offset long")
    files = spark.createDataFrame([(1, "/a"), (2, "/b")], "file_id long, path string")
    lines = [r.value for r in store.pair_text_lines(pairs, files).collect()]
    assert "\n".join(lines) == "\n=== 2 duplicate pair(s) ===\n\n  [100.0% via audio  offset 3.0s]\n    A: /a\n    B: /b\n\n  [95.5% via frame]\n    A: /a\n    B: ?\n"
    assert [r.value for r in store.pair_text_lines(pairs.limit(0), files).collect()] == ["No duplicates found."]
