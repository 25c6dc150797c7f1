"""Hand vectors, models in plain Python, and invariance."""

import math
import random
import time

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import grouping as G
from kindred.operators import joins as J
from kindred.operators import kernels as K
from kindred.operators.graph import connected_components
from kindred.sources import store
from kindred.sources.probe import media_info
from kindred.streaming.ingest import changes, ingest, latest, progress


def one(spark, sql, expr):
    return spark.sql(f"select {sql}").select(expr.alias("r")).first()["r"]


def test_sliding_hamming(spark):
    r = one(spark, "array(3735928559L, 3405691582L) s, array(4294967295L, 286331153L, 572662306L, 3735928559L, 3405691582L, 858993459L) l", K.sliding_hamming("s", "l", 90))
    assert (r.bits, r.offset) == (0, 3)
    assert one(spark, "array(0L) s, array(4294967295L) l", K.sliding_hamming("s", "l", 90)) is None


def test_sliding_runs(spark):
    r = one(spark, "array_repeat(0L, 6) s, array(0L, 0L, 0L, -1L, 0L, 0L, 0L) l", K.sliding_runs("s", "l", 9, 1))
    assert (r.match, r.run, r.offset) == (5, 6, 0)
    assert one(spark, "array_repeat(0L, 6) s, array_repeat(0L, 3) l", K.sliding_runs("s", "l", 9, 1)) is None


def test_tolerance(spark):
    f = lambda d, *a: one(spark, f"{d}D d", J.tolerance(F.col("d"), *a))
    assert (f(3600, 1), f(60, 1, 5), f(3600, 1, 0, 10), f(60, 0, 0, 15), f(60, 0)) == (36, 5, 10, 15, 0)


def test_bytes_text(spark):
    got = [one(spark, f"{n}L b", S.bytes_text(F.col("b"))) for n in (0, 512, 1024, 1536, 1048576, 1073741824, 1099511627776)]
    assert got == ["0 B", "512.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB", "1.0 TB"]


def test_hamming_budget():
    assert K.hamming_budget(0.95) == 3 and K.hamming_budget(0.85) == 9
    with pytest.raises(ValueError):
        K.hamming_budget(1.5)


def plain_hash(frame):
    """Every cell as a double sum, their median, one bit each."""
    cells = [sum(frame[32 * y + x] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for y in range(32) for x in range(32)) for v in range(1, 9) for u in range(1, 9)]
    low, high = sorted(cells)[31:33]
    value = sum(1 << i for i, c in enumerate(cells) if c > (low + high) / 2)
    return value - (1 << 64) if value >> 63 else value


def test_perceptual_hash(spark):
    rnd = random.Random(5)
    frames = [[rnd.randrange(256) for _ in range(1024)] for _ in range(6)]
    rows = [(i, f, bytearray(f)) for i, f in enumerate(frames)] + [(6, None, None), (7, [1, 2], bytearray(b"x"))]
    got = spark.createDataFrame(rows, "i int, f array<int>, b binary").select("i", K.perceptual_hash("f").alias("x"), K.perceptual_hash("b").alias("y")).orderBy("i").collect()
    assert [(r.x, r.y) for r in got] == [(plain_hash(f),) * 2 for f in frames] + [(None, None)] * 2


def test_perceptual_hash_of_cells_that_lie_close():
    """Frames whose middle cells single precision would swap."""
    i = np.arange(1024)
    place = ((i // 32) * (i // 32) + 3 * (i // 32) * (i % 32) + 7 * (i % 32)) % 64
    frames = np.random.default_rng(2).integers(108, 149, (300_000, 64))[[64_114, 277_898]][:, place]
    assert K._hash_frames(frames).tolist() == [plain_hash(f) for f in frames.tolist()]


def test_sliding_matches(spark):
    pattern = lambda seed: [sum(((13 * (i + 8 * k) + 97 * seed) % 256) << (8 * k) for k in range(7)) for i in range(50)]
    long = pattern(1)
    df = spark.createDataFrame([(long[20:30], long), ([0] * 3, [0, 0]), ([], [1])], "s array<long>, l array<long>")
    r = [x.r for x in df.select(K.sliding_matches("s", "l", 3, 0).alias("r")).collect()]
    assert (r[0].match, r[0].run, r[0].offset) == (10, 10, 20) and r[1] is None and r[2] is None
    gap = spark.sql("select array(0L, 0L, 0L, 0L, 0L) s, array(0L, 0L, -1L, 0L, 0L) l")
    assert [tuple(gap.select(K.sliding_matches("s", "l", 3, g).alias("r")).first().r) for g in (0, 1)] == [(4, 2, 0), (4, 4, 0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_hamming_join_is_lossless(spark, parts):
    rnd = random.Random(4)
    base = [rnd.getrandbits(60) for _ in range(30)]
    rows = [(i, base[i % 30] ^ (1 << rnd.randrange(60) if i % 3 else 0)) for i in range(150)]
    got = J.hamming_join(spark.createDataFrame(rows, "id long, hash long").repartition(parts), 60, 2)
    want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 2}
    assert [tuple(r) for r in sorted(got.collect())] == sorted(want)


@pytest.mark.parametrize("words", [3, 65535])
def test_text_votes(spark, monkeypatch, words):
    """Nulls, empty texts, spaces in a row, keys that repeat or are null, letters of several bytes, texts of more words than are counted at a time: as by the votes over rows. Words aren't rows of their own."""
    monkeypatch.setattr(K, "WORDS", words)
    texts = [(1, "a b  a"), (2, ""), (3, None), (1, "c é漢 b "), (None, "x"), (None, " y"), (4, "long " * 70_000 + "er er"), (5, "a b c d"), (6, None), (6, "z z\ny")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = df.select("doc_id", F.explode(F.split("text", " ", -1)).alias("w")).select("doc_id", F.conv(F.substring(F.md5("w"), 1, 15), 16, 10).cast("long").alias("h"))
    want = sorted(map(repr, K.majority_vote(rows, "doc_id", "h", 60).collect()))
    for parts in (1, 5):
        got = K.text_votes(df.repartition(parts), "doc_id", "text")
        assert sorted(map(repr, got.collect())) == want and len(want) == 6
    assert K.text_votes(df.where("text is null"), "doc_id", "text").count() == 0
    from kindred.plans.registry import word_hashes
    assert "Generate" not in word_hashes(df)._jdf.queryExecution().executedPlan().toString()


def test_hamming_join_broadcasts_nothing(spark):
    """Tables that explode makes many times larger than Spark's sizes say don't pass through the driver."""
    rows = spark.range(20_000).select("id", F.xxhash64("id").bitwiseAND((1 << 60) - 1).alias("hash"))
    assert "Broadcast" not in J.hamming_join(rows, 60, 2)._jdf.queryExecution().executedPlan().toString()


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_groups(spark):
    pairs = spark.createDataFrame([(1, 2, 0, 0), (2, 3, 0, 255), (4, 5, 7, 7)], "a long, b long, ha long, hb long")
    assert sorted(map(tuple, G.constrained_groups(pairs, 3).collect())) == [(1, 1), (1, 2), (4, 4), (4, 5)]
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    sizes = G.split_chains(chain).groupBy("group_id").count().collect()
    assert all(r["count"] >= 2 for r in sizes)
    merged = G.timeline_groups(spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "a long, b long"))
    assert {tuple(r) for r in merged.collect()} == {(1, 1), (1, 2), (1, 3), (1, 4)}


def edges_of(seed):
    rnd = random.Random(seed)
    return sorted({tuple(rnd.sample(range(25), 2)) for _ in range(rnd.randint(1, 30))})


@pytest.mark.parametrize("seed", range(4))
def test_timeline_groups_match_a_fold(spark, seed):
    group = {}
    edges = edges_of(seed)
    for s, c in edges:
        g = group[s] if s in group else group[c] if c in group else s
        group.setdefault(s, g)
        group.setdefault(c, g)
    got = G.timeline_groups(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((g, x) for x, g in group.items())


def test_constrained_groups_match_a_model(spark):
    """Sets of members with the hash of the first file; merges keep the first set's. 40 graphs side by side, in whole and in small blocks."""
    rows, want = [], []
    for seed in range(40):
        rnd = random.Random(seed)
        value = {x: rnd.choice([0, 1, 3, 255, 254]) for x in range(25)}
        groups = []
        for a, b in edges_of(seed):
            if a == b:
                continue
            rows.append((100 * seed + a, 100 * seed + b, value[a], value[b]))
            mine = [next((g for g in groups if x in g[1]), None) for x in (a, b)]
            if mine == [None, None]:
                groups.append([value[a], {a, b}])
            elif None not in mine:
                if mine[0] is not mine[1] and (mine[0][0] ^ mine[1][0]).bit_count() <= 2:
                    mine[0][1] |= mine[1][1]
                    groups = [g for g in groups if g is not mine[1]]
            else:
                g, new = (mine[0], b) if mine[1] is None else (mine[1], a)
                if (g[0] ^ value[new]).bit_count() <= 2:
                    g[1].add(new)
        want += [(100 * seed + min(m), 100 * seed + x) for _, m in groups for x in m]
    pairs = spark.createDataFrame(rows, "a long, b long, ha long, hb long")
    for block in (200_000, 7):
        assert sorted(map(tuple, G.constrained_groups(pairs, 2, block).collect())) == sorted(want)


def test_constrained_groups_of_a_chain(spark):
    """100,000 pairs, each waiting for the one before it, in five blocks; every 1,000th file is unlike the lead."""
    n = 100_000
    hash_of = lambda x: 255 if x % 1000 == 999 else 0
    group, lead = {0: 0}, {0: hash_of(0)}
    for a in range(n):
        g = group.get(a)
        if g is None:
            group[a] = group[a + 1] = a
            lead[a] = hash_of(a)
        elif (lead[g] ^ hash_of(a + 1)).bit_count() <= 2:
            group[a + 1] = g
    pairs = spark.range(n).selectExpr("id as a", "id + 1 as b", "if(id % 1000 = 999, 255L, 0L) as ha", "if((id + 1) % 1000 = 999, 255L, 0L) as hb")
    got = {r.member: r.group_id for r in G.constrained_groups(pairs, 2, 20_000).collect()}
    assert got == group


def test_constrained_groups_of_odd_rows(spark):
    kind = "a long, b long, ha long, hb long"
    assert G.constrained_groups(spark.createDataFrame([], kind), 2).count() == 0
    rows = [(None, 1, 0, 0), (1, None, 0, 0), (5, 5, 0, 0), (1, 2, None, None), (1, 2, None, None), (2, 3, None, 0), (7, 8, -1, -1), (8, 9, -1, -2), (9, 10, -2, 0)]
    assert sorted(map(tuple, G.constrained_groups(spark.createDataFrame(rows, kind), 2, 2).collect())) == [(1, 1), (1, 2), (7, 7), (7, 8), (7, 9)]


def split_model(edges):
    """Groups by degrees counted anew each time; what left is gathered in the order in which it left."""
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)

    def reach(start, among, key):
        part, todo = [], [start]
        while todo:
            x = todo.pop(0)
            part.append(x)
            todo += sorted((links[x] & among) - set(part) - set(todo), key=key)
        return part

    def prune(items):
        gone = []
        while len(items) > 2:
            degree = {x: len(links[x] & set(items)) for x in items}
            worst = min(items, key=lambda x: (degree[x], items.index(x)))
            if degree[worst] >= len(items) // 2:
                break
            items = [x for x in items if x != worst]
            gone.append(worst)
        return items, gone

    want, seen = [], set()
    for x in sorted(links):
        if x not in seen:
            whole = sorted(reach(x, set(links), None))
            seen |= set(whole)
            kept, gone = prune(whole)
            parts, left = [kept], set(gone)
            for y in gone:
                if y in left:
                    part = reach(y, left, gone.index)
                    left -= set(part)
                    parts.append(prune(part)[0])
            want += [(min(p), m) for p in parts if len(p) > 1 for m in p]
    return want


def test_split_chains_match_a_model(spark):
    rows, want = [], []
    for seed in range(80):
        rnd = random.Random(seed)
        edges = sorted({tuple(rnd.sample(range(30), 2)) for _ in range(rnd.randint(1, 60))})
        rows += [(100 * seed + a, 100 * seed + b) for a, b in edges]
        want += [(100 * seed + g, 100 * seed + x) for g, x in split_model(edges)]
    assert sorted(map(tuple, G.split_chains(spark.createDataFrame(rows, "a long, b long")).collect())) == sorted(want)


def test_split_chains_of_a_long_chain():
    """One component of 40,000 links in one task: the last three of a chain stay, and of those that left also."""
    n = 40_000
    got = G._split(pd.DataFrame({"a": range(n), "b": range(1, n + 1)}))
    assert sorted(len(g) for _, g in got.groupby("group_id").member) == [3, 3]


def test_probe(spark):
    text = '{"streams":[{"index":0,"codec_name":"hevc","codec_type":"video","width":3840,"height":2160,"r_frame_rate":"24000/1001","color_transfer":"smpte2084","side_data_list":[{"side_data_type":"DOVI configuration record"},{"side_data_type":"x"}]},{"index":1,"codec_type":"audio","sample_rate":"48000","channels":6,"r_frame_rate":"0/0"}],"format":{"duration":"3.9","bit_rate":"1000"}}'
    rows = [(1, text), (2, text.replace('"index":1,', '"index":1,"bit_rate":"64000",').replace('"3.9"', '"-1"')), (3, "nonsense"), (4, None), (5, "{}")]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, j string").select("i", media_info("j").alias("m")).collect()}
    one_, two = got[1].streams
    assert got[1].duration == 3 and (one_.width, one_.bit_rate, one_.hdr_format, one_.side_data) == (3840, 1000, "Dolby Vision", "DOVI configuration record|x")
    assert abs(one_.frame_rate - 23.976) < 0.001 and (two.sample_rate, two.channels, two.frame_rate, two.bit_rate, two.hdr_format) == (48000, 6, -1.0, None, None)
    assert got[2].duration is None and [s.bit_rate for s in got[2].streams] == [None, 64000]
    assert all(got[i].duration is None and got[i].streams == [] for i in (3, 4, 5))


def test_globs_and_predicates(spark):
    hit = lambda path, glob: one(spark, f"'{path}' p", S.glob_hit(F.col("p"), glob))
    assert hit("/a/dx/b", "d?") and not hit("/a/d/x", "d?x") and hit("/a/d.x/b", "*.x") and not hit("/a/dyx", "d.x") and hit("/a/b", "/a/*")
    with pytest.raises(ValueError):
        S.user_filter(spark.range(1), "updated_at > 0")
    assert [tuple(one(spark, f"'{h}' h", S.byte_range(F.col("h"), F.lit(10))) or ()) for h in ("bytes=0-3", "bytes=4-", "bytes=-3", "bytes=8-99", "bytes=10-", "bytes=5-4", "x", "bytes=-")] == [(0, 3), (4, 9), (7, 9), (8, 9), (), (), (), ()]


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 10).alias("w")).repartition(7)
    got = sorted((r["rank"], r.w, r.v) for r in S.global_rank(df, [F.col("w").asc(), F.col("v").desc()], "rank").collect())
    assert [r[0] for r in got] == list(range(1, 5001)) and [(r[1], -r[2]) for r in got] == sorted((r[1], -r[2]) for r in got)


def test_blacklist_json(spark):
    got = store.parse_blacklist(spark.createDataFrame([('{"version":1,"groups":[["a","b"],["c"]]}',), ('[["d"]]',), ("nonsense",)], "value string"))
    assert sorted(map(tuple, got.collect())) == [(0, "a"), (0, "b"), (0, "d"), (1, "c")]


def test_discover(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for n in ("a/x.MP4", "a/b/y.jpg", "a/z.txt"):
        (tmp_path / n).write_text("x")
    got = {r.path.rsplit("/", 1)[1] for r in store.discover(spark, str(tmp_path), excluded=(f"{tmp_path}/a/b",)).collect()}
    assert got == {"x.MP4"}


def test_ingest_equals_batch(spark, tmp_path):
    src, root = f"{tmp_path}/src", f"{tmp_path}/root"
    schema = spark.createDataFrame([], "id long, size long").schema
    for rows in ([(1, 10), (2, 20)], [(2, 21), (3, 30)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        ingest(spark, src, schema, root, "id", ["size"], f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, latest(spark, root).collect())) == [(1, 10), (2, 21), (3, 30)]


def test_a_batch_that_is_replayed(spark, tmp_path):
    """A batch whose write succeeded but whose commit was lost writes the same version again."""
    src, root, cp = (f"{tmp_path}/{n}" for n in ("src", "root", "cp"))
    schema = spark.createDataFrame([], "id long, size long").schema
    for rows in ([(1, 10), (2, 20)], [(2, 21), (3, 30)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        ingest(spark, src, schema, root, "id", ["size"], cp).awaitTermination()
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    ingest(spark, src, schema, root, "id", ["size"], cp).awaitTermination()
    assert sorted(map(tuple, latest(spark, root).collect())) == [(1, 10), (2, 21), (3, 30)]


def test_feeds(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, size long, event_type string").schema
    spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 5, "a")], schema).write.parquet(f"{tmp_path}/src")
    feed, seen, timed = (f"{tmp_path}/{n}" for n in ("feed", "seen", "timed"))
    changes(spark, f"{tmp_path}/src", schema, "id", feed, f"{tmp_path}/c1").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(feed).drop("batch").collect())) == [(1, 12, "b", 2), (2, 5, "a", 1)]
    progress(spark, f"{tmp_path}/src", schema, seen, f"{tmp_path}/c2").awaitTermination()
    assert sorted(map(tuple, latest(spark, seen).collect())) == [("a", 2), ("b", 1)]
    spark.createDataFrame([(2, 4, "c"), (2, 9, "c")], schema).write.mode("append").parquet(f"{tmp_path}/src")
    changes(spark, f"{tmp_path}/src", schema, "id", feed, f"{tmp_path}/c1").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(feed).where("batch > 0").drop("batch").collect())) == [(2, 9, "c", 3)]
    progress(spark, f"{tmp_path}/src", schema, seen, f"{tmp_path}/c2").awaitTermination()
    assert sorted(map(tuple, latest(spark, seen).collect())) == [("a", 2), ("b", 1), ("c", 2)]
    running = progress(spark, f"{tmp_path}/src", schema, timed, f"{tmp_path}/c3", every="1 hour")
    stop = time.time() + 60
    while latest(spark, timed) is None and time.time() < stop:
        time.sleep(0.2)
    running.stop()
    assert latest(spark, timed).count() == 3


def test_stores(spark, tmp_path):
    texts = spark.createDataFrame([('[["a","b"]]',), ("{broken",), ('{"version":1}',), (None,)], "value string")
    assert sorted(str(r.value) for r in store.quarantined(texts).collect()) == ["None", '{"version":1}', "{broken"]
    entries = spark.createDataFrame([(4, "b"), (4, "a"), (9, 'c"d')], "entry_id int, path string")
    text = store.blacklist_json(entries)
    assert text.first().value == '{"version":1,"groups":[["a","b"],["c\\"d"]]}'
    for content in (text, text.select(F.upper("value").alias("value"))):
        store.write_report(content, f"{tmp_path}/list", "text")
    assert spark.read.text(f"{tmp_path}/list").first().value.startswith('{"VERSION"') and not (tmp_path / "list.new").exists()
    files = spark.createDataFrame([(1, "/x/a.mp4", 5, 60, 10, 20), (2, "/x/b.mp4", 6, 61, 10, 20)], "file_id long, path string, size_bytes long, duration long, width int, height int")
    pairs = spark.createDataFrame([(1, 2, 950, "AudioMatch", 7), (1, 3, 900, "AudioMatch", 7)], "file_a long, file_b long, sim long, method string, clip_offset long")
    values = [r.value for r in store.pair_json(pairs, files).collect()]
    (tmp_path / "pairs.json").write_text("[" + ",".join(values) + "]")
    back = store.read_pairs(spark, f"{tmp_path}/pairs.json").collect()
    assert len(back) == 1 and back[0].file_a.path == "/x/a.mp4" and back[0].file_b.name == "b.mp4" and abs(back[0].similarity - 0.95) < 1e-6
    lines = sorted(r.line for r in store.csv_lines(store.pair_report(pairs, files)).collect())
    assert lines == ["0.9000,audio,7.000,/x/a.mp4,5,60.000,10,20,,0,0.000,0,0", "0.9500,audio,7.000,/x/a.mp4,5,60.000,10,20,/x/b.mp4,6,61.000,10,20"]
