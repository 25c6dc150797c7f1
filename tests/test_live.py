"""Live compare, feeds and life cycles, the versioned store, the audio front end and the visual gate against plain versions."""

import json
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import chroma as C
from kindred.operators import gate
from kindred.operators import grouping as G
from kindred.operators import joins as J
from kindred.operators.gate import gate_every_pair, visual_gate
from kindred.operators.retrieval import bm25_index, bm25_top
from kindred.plans import registry
from kindred.sources import store
from kindred.sources.versioned import Finding, VersionedStore
from kindred.streaming import lifecycle
from kindred.streaming.compare import LiveCompare, equal_rule, hamming_rule

RECORD = "id long, hash long, size long, folder string"


def plain_pairs(records, same_folder=False):
    out, ids = set(), sorted(records)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (h, s, f), (k, t, g) = records[a], records[b]
            if same_folder and f != g:
                continue
            if h is not None and k is not None and bin((h ^ k) & (2**64 - 1)).count("1") <= 2:
                out.add((a, b, "hash"))
            elif s is not None and s == t:
                out.add((a, b, "size"))
    return out


def arrivals(seed, batches=4):
    """Batches of records; ids come again with other hashes, sizes and folders, so that pairs go and others come."""
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(5)]

    def record():
        h = rng.choice([None, *base, -1, 0])
        return (h if h is None else h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) if h > 0 else h, rng.choice([None, *range(6)]), rng.choice("xy"))

    return [{rng.randrange(40): record() for _ in range(rng.randrange(5, 15))} for _ in range(batches)]


def rules():
    return [hamming_rule("hash", "hash", 64, 2), equal_rule("size", "size")]


def frame(spark, batch):
    return spark.createDataFrame([(i, *r) for i, r in batch.items()] + [(None, 1, 1, "x")], RECORD)


@pytest.mark.parametrize("same_folder", [False, True])
def test_live_compare_equals_all_pairs(spark, tmp_path, same_folder):
    live, known = LiveCompare(spark, str(tmp_path), rules(), "x.folder = y.folder" if same_folder else "true"), {}
    assert live.pairs() is None and live.catalog() is None
    for n, batch in enumerate(arrivals(1)):
        known |= batch
        live.process(frame(spark, batch), n)
        assert {tuple(r) for r in live.pairs().collect()} == plain_pairs(known, same_folder)
    assert {r.id: (r.hash, r.size, r.folder) for r in live.catalog().collect()} == known


def test_live_compare_replayed_and_streamed(spark, tmp_path):
    """A batch that runs again, also half-way, changes nothing; a stream over files ends as all pairs; so do the links of each file by themselves."""
    batches, known = arrivals(2), {}
    live = LiveCompare(spark, str(tmp_path / "live"), rules())
    for n, batch in enumerate(batches):
        known |= batch
        live.process(frame(spark, batch), n)
        before = {tuple(r) for r in live.pairs().collect()}
        if n == 2:  # it stopped after its records, before its pairs
            live.files.delete(f"pairs/batch={n}")
        live.process(frame(spark, batch), n)
        assert {tuple(r) for r in live.pairs().collect()} == before == plain_pairs(known)
    for n, batch in enumerate(batches):
        spark.createDataFrame([(i, *r) for i, r in batch.items()], RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
    other = LiveCompare(spark, str(tmp_path / "streamed"), rules())
    other.start(str(tmp_path / "inbox"), live.catalog().schema, str(tmp_path / "checkpoint"), per_batch=1).awaitTermination()
    got = {tuple(r) for r in other.pairs().collect()}
    assert got == plain_pairs(known) and len(other._log("records").select("batch").distinct().collect()) == len(batches)
    for target in known:
        assert {p for p in got if target in p[:2]} == {p for p in plain_pairs(known) if target in p[:2]}


def test_live_compare_joins_no_pairs_while_nothing_comes_again(spark, tmp_path):
    live, known = LiveCompare(spark, str(tmp_path), rules()), {}
    for n, batch in enumerate([{i: (i // 2 * 1000 + i, i % 3, "x") for i in range(at, at + 12)} for at in (0, 12)]):
        known |= batch
        live.process(frame(spark, batch), n)
    pairs = live.pairs()
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(known)


def test_store_keeps_a_whole_version_wherever_a_writer_stops(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store = VersionedStore(spark, root)
    table = lambda n: spark.range(n).selectExpr("id", "id * 2 as v")
    assert store.load() is None and store.repair() == []
    assert store.save(table(3)) == 1 and store.load().count() == 3
    for step in ("_write", "_publish", "_drop_old"):
        with monkeypatch.context() as m:
            real = getattr(VersionedStore, step)

            def stop(self, *args, step=step, real=real):
                if step == "_write":
                    real(self, args[0].limit(1), args[1])
                raise KeyboardInterrupt

            m.setattr(VersionedStore, step, stop)
            with pytest.raises(KeyboardInterrupt):
                store.save(table(5))
        assert store.load().count() == (5 if step == "_drop_old" else 3)
    store.files.write("commits/000009.new", "{")  # it stopped between the commit's write and its rename
    assert store.load().count() == 5
    assert {(f.state, f.action) for f in store.repair()} == {("whole", "kept"), ("unfinished", "deleted")}
    assert store.load().count() == 5 and not [n for n in os.listdir(f"{root}/commits") if n.endswith(".new")]
    assert store.save(store.load().where("id > 0")) > 4 and store.load().count() == 4
    assert len(store.versions()) == 2


def damage(kind, store, version):
    folder = f"{store.files.root}/data/v{version:06d}"
    part = next(f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("part-"))
    crc = f"{folder}/.{os.path.basename(part)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    if kind == "missing":
        os.remove(part)
    elif kind == "short":
        os.truncate(part, 10)
    elif kind == "bytes":
        size = os.path.getsize(part)
        with open(part, "r+b") as f:
            f.seek(size - 40)
            f.write(b"\xff" * 40)
    else:
        store.files.write(f"commits/{version:06d}", {"empty": "", "torn": '{"rows": 3', "list": "[1]", "rows": json.dumps({"rows": 4, "files": {}})}[kind])


@pytest.mark.parametrize("kind,state,action", [("missing", "torn", "set aside"), ("short", "torn", "set aside"), ("bytes", "damaged", "set aside"), ("rows", "damaged", "set aside"), ("torn", "torn", "set aside"), ("list", "torn", "set aside"), ("empty", "empty", "deleted")])
def test_store_repair(spark, tmp_path, kind, state, action):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.save(spark.range(2))
    store.save(spark.range(3).coalesce(1))
    damage(kind, store, 2)
    assert store.state(2) == state and store.load().count() == 2
    assert store.repair() == [Finding(1, "whole", "kept"), Finding(2, state, action)]
    assert store.versions() == [1] and store.load().count() == 2
    assert bool(store.files.sizes("damaged")) == (action == "set aside")


def test_store_takes_over_a_table_without_versions(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "s/old"))
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.repair("old") == [Finding(1, "whole", "taken over")] and store.load().count() == 7
    assert store.repair("old") == [Finding(1, "whole", "kept")]


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_job_feed(spark, tmp_path):
    """Commands in three runs of the stream, so that state comes back from the checkpoint; illegal ones are refused and change nothing."""
    rng, schema = random.Random(4), "job long, at long, command string"
    commands = ["create", "start", "progress", "finish", "fail", "cancel", "nonsense", None]
    state, want = {}, []
    seqs = {}
    for run in range(3):
        rows = [(rng.choice([None, *range(6)]), run * 100 + i, rng.choice(commands)) for i in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = lifecycle.job_feed(stream(spark, str(tmp_path / "in"), schema), "job", ["at"], F.col("command"))
        lifecycle.to_files(feed, str(tmp_path / "feed"), str(tmp_path / "check")).awaitTermination()
        for job, _, command in rows:
            if job is None:
                continue
            before = state.get(job)
            after = lifecycle.JOB_STEPS.get(before, {}).get(command)
            seqs[job] = seqs.get(job, 0) + 1
            want.append((job, seqs[job], "refuse" if after is None else "insert" if before is None else "update", command, before, after or before))
            if after:
                state[job] = after
    got = lifecycle.read_feed(spark, str(tmp_path / "feed"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r.key: r.state for r in lifecycle.newest(got).collect()} == state
    assert lifecycle.broken_images(got).count() == 0
    assert lifecycle.broken_images(got.where("not (key = 1 and seq = 2)")).count() <= 1
    assert {"refuse", "insert", "update"} == {r.action for r in got.collect()}


def test_change_feed_replays_to_the_newest_table(spark, tmp_path):
    rng, schema = random.Random(5), "id string, at long, name string, size long"
    newest, changes = {}, 0
    for run in range(3):
        rows = [(f"k{rng.randrange(5)}", run * 100 + i, rng.choice(["a", None]), rng.randrange(2)) for i in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for k, _, name, size in rows:
            changes += newest.get(k) != (name, size)
            newest[k] = (name, size)
    feed = lifecycle.change_feed(stream(spark, str(tmp_path / "in"), schema), "id", ["at"])
    lifecycle.to_files(feed, str(tmp_path / "feed"), str(tmp_path / "check")).awaitTermination()
    got = lifecycle.read_feed(spark, str(tmp_path / "feed"))
    replayed = lifecycle.newest(got).select("key", F.from_json("state", "name string, size long").alias("r")).select("key", "r.*")
    assert {r.key: (r.name, r.size) for r in replayed.collect()} == newest
    assert got.count() == changes and lifecycle.broken_images(got).count() == 0


def plain_fingerprint(x, p):
    """The pipeline frame by frame, with the slots closed one at a time."""
    frames, filtered, votes, closed = [], [], [], 0
    for f in range(max(0, (len(x) - p.size) // p.hop + 1)):
        w = [x[f * p.hop + k] * p.scale * 0.5 * (1 - np.cos(2 * np.pi * k / (p.size - 1))) for k in range(p.size)]
        energy = np.zeros(12)
        for i in range(1, p.size // 2):
            hz = i * p.rate / p.size
            if p.low <= hz <= p.high:
                angle = 2 * np.pi * i * np.arange(p.size) / p.size
                energy[int(12 * np.log2(hz / p.low)) % 12] += np.dot(w, np.cos(angle)) ** 2 + np.dot(w, np.sin(angle)) ** 2
        frames.append(energy)
        if f < 4:
            continue
        y = sum(t * frames[f - k] for k, t in enumerate([0.1, 0.2, 0.4, 0.2, 0.1]))
        y = y / np.sqrt((y**2).sum()) if (y**2).sum() >= 1e-10 else y * 0
        bits = [y[i] > y[(i + 1) % 12] for i in range(12)] + [y[i] > y[(i + 3) % 12] for i in range(12)] + [y[i] > y[(i + 6) % 12] for i in range(8)]
        if filtered and f * p.hop // p.rate > closed:
            votes.append(filtered)
            filtered, closed = [], closed + 1
        filtered.append(bits)
    votes += [filtered] if filtered else []
    return frames, [sum(1 << b for b in range(32) if sum(v[b] for v in second) >= len(second) // 2 + 1) for second in votes]


@pytest.mark.parametrize("p", [C.ChromaParams(rate=40, size=32, hop=9, low=1.5, high=19.0, block=3, scale=1.0), C.ChromaParams(rate=10, size=32, hop=25, low=0.5, high=4.9, block=1, scale=1.0), C.ChromaParams(rate=40, size=16, hop=20, low=2.6, high=19.0, block=64, scale=1.0)])
def test_fingerprint(spark, p):
    """Series around the length of frames and blocks, with gaps and nulls, cut into blocks of few frames."""
    rng, rows, want = np.random.default_rng(1), [], {}
    for series, n in enumerate([1, p.size - 1, p.size, p.size + p.hop, p.size + 4 * p.hop, p.size + 5 * p.hop - 1, 700, 701]):
        x = rng.normal(0, 1, n)
        if series == 7:
            x[100:130] = 0.0
        want[series] = plain_fingerprint(x, p)
        rows += [(series, i, None if i == 100 else float(v)) for i, v in enumerate(x) if not (series == 7 and 101 <= i < 130)] if series == 7 else [(series, i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "s long, at long, x double").repartition(3)
    got = {}
    for r in C.chroma(df, "s", "at", "x", p).collect():
        got.setdefault(r.series, {})[r.frame] = r.energies
    assert got.keys() == {s for s, (f, _) in want.items() if f}
    assert all(sorted(got[s]) == list(range(len(f))) and np.allclose([got[s][i] for i in range(len(f))], f) for s, (f, _) in want.items() if f)
    votes = {}
    for r in C.fingerprint(df, "s", "at", "x", p).collect():
        votes.setdefault(r.series, {})[r.slot] = r.vote
    assert votes == {s: dict(enumerate(v)) for s, (_, v) in want.items() if v}


def test_tone_has_its_class(spark):
    """440 Hz is four octaves above the lowest class, its bins on either side of that; two seconds of it at the usual rate."""
    p = C.ChromaParams()
    tone = spark.range(2 * p.rate).selectExpr("1 as s", "id as at", f"10000 * sin(2 * pi() * 440 * id / {p.rate}) as x")
    energies = [r.energies for r in C.chroma(tone, "s", "at", "x").collect()]
    assert len(energies) == (2 * p.rate - p.size) // p.hop + 1 and all(e[0] + e[11] > 0.99 * sum(e) for e in energies)


def test_visual_gate(spark):
    """Nearest frames with ties, ends left out, files without frames, unknown lengths."""
    frames = spark.createDataFrame([("c", float(t), [t] * 4) for t in (0, 2, 4, 6, 8)] + [("s", t / 2, [int(t / 2) % 256] * 4) for t in range(60)] + [("s", None, [0] * 4), ("s", 3.0, None)], "file string, ts double, gray array<int>")
    pairs = [("c", "s", 0, 8.0, 30.0), ("c", "s", 20, 8.0, 30.0), ("c", "s", 26, 8.0, 30.0), ("c", "none", 0, 8.0, 30.0), ("c", "s", 1, 0.0, 30.0), ("c", "s", 2, 2.0, 30.0), ("s", "c", 3, 9.0, None)]
    df = spark.createDataFrame(pairs, "clip string, source string, offset long, clip_secs double, source_secs double")
    got = {tuple(r)[:3]: (r.n_compared, r.similarity, r.passes) for r in visual_gate(df, frames).select("clip", "source", "offset", "n_compared", "similarity", "passes").collect()}
    # Places 2.64 and 5.28 of an 8 s clip: frames of second 2 and 6; in the source those of 2.5 and 5.5, whose values are 2 and 5.
    assert got["c", "s", 0] == (2, pytest.approx(1 - (0 + 1) / 2 / 256), True)
    assert got["c", "s", 20] == (2, pytest.approx(1 - (20 + 19) / 2 / 256), True)
    assert got["c", "s", 26] == (1, pytest.approx(1 - 26 / 256), True)
    assert got["c", "none", 0] == (0, None, True) and got["c", "s", 1] == (0, None, True) and got["s", "c", 3] == (0, None, True)
    assert got["c", "s", 2] == (1, pytest.approx(1 - 3 / 256), True)  # 1.0 is as near to 0 as to 2: the earlier one
    far = frames.where("file = 's'").union(spark.createDataFrame([("c", 0.0, [255] * 4)], frames.schema))
    assert [r.passes for r in visual_gate(df.limit(1), far).collect()] == [False]


def test_gate_of_every_pair(spark, data, monkeypatch):
    """As the gate of listed pairs: files without frames, of no length, with a null id, grays of another size or with a hole; in blocks of 5, and all in one whose tables come in pieces."""
    rnd = random.Random(6)
    secs = {f"f{i}": rnd.choice([0.0, 2.0, 5.0, 9.0, 12.5, 30.0, 31.0]) for i in range(18)} | {None: 7.0}
    shots = [(f, t, [rnd.randrange(256) for _ in range(rnd.choice([4, 4, 4, 5]))]) for f, n in secs.items() if f not in ("f3", "f4") for t in rnd.sample([x / 2 for x in range(70)], rnd.randrange(1, 9))]
    shots += [("f1", 1.0, [1, None, 2, 3]), ("f2", None, [0] * 4), ("f2", 3.0, None)]
    frames = spark.createDataFrame(shots, "file string, ts double, gray array<int>")
    number = lambda f: 0 if f is None else int(f[1:])
    pairs = [(c, s, None if None in (c, s) else (number(c) * 7 + number(s)) % 9, secs[c], secs[s]) for c in secs for s in secs if secs[c] < secs[s]]
    listed = visual_gate(spark.createDataFrame(pairs, "clip string, source string, offset long, clip_secs double, source_secs double"), frames)
    want = {(r.clip, r.source): (r.n_compared, None if r.similarity is None else round(r.similarity, 9), r.passes) for r in listed.collect()}
    assert len(want) > 100 and {n for n, *_ in want.values()} == {0, 1, 2, 3} and {p for *_, p in want.values()} == {True, False}
    files = spark.createDataFrame([*secs.items(), ("unknown", None)], "file string, secs double")
    offset = lambda clip, source, clip_secs, source_secs: np.array([(int((c or "f0")[1:]) * 7 + int((s or "f0")[1:])) % 9 for c, s in zip(clip, source)])
    for block in (5, None):
        got = gate_every_pair(files, frames, offset, block=block).collect()
        assert len(got) == len(want) and {(r.clip, r.source): (r.n_compared, None if r.similarity is None else round(r.similarity, 9), r.passes) for r in got} == want
    monkeypatch.setattr(gate, "CELLS", 150)
    monkeypatch.setattr(gate, "ROWS", 7)
    kind = pa.list_(pa.struct([("ts", pa.float64()), ("gray", pa.list_(pa.int32()))]))
    ids = sorted((f for f in secs if f), key=lambda f: (secs[f], f))
    held = [sorted(((t, g) for x, t, g in shots if x == f and t is not None and g is not None), key=lambda x: x[0]) for f in ids]
    places = lambda n: [n * x for x in ((0.25, 0.5, 0.75) if n >= 9 else (0.33, 0.66) if n >= 3 else (0.5,))]
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([secs[f] for f in ids]), pa.array([places(secs[f]) for f in ids]), pa.array([[{"ts": t, "gray": g} for t, g in x] for x in held], kind)], ["file", "secs", "at", "frames"])
    with pa.ipc.new_stream(out := pa.BufferOutputStream(), rows.schema) as to:
        to.write_batch(rows)
    block = gate._Files(out.getvalue().to_pybytes())
    assert len(list(block.pieces())) > 3
    pieces = [r for b in gate._compare(block, block, offset) for r in b.to_pylist()]
    assert {(r["clip"], r["source"]): (r["n_compared"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in pieces} == {k: v[:2] for k, v in want.items() if None not in k}
    plan = registry.QUERIES["SIM8_visual_gate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_documents_of_lines(spark, tmp_path):
    """The files put together are one JSON document; what is read is in its order, whichever way it is written."""
    entries = [(i * 3, f"/p{i}/{j}\"x") for i in range(300) for j in range(1 + i % 3)]
    df = spark.createDataFrame(entries, "entry_id int, path string").repartition(7)
    store.write_lines(store.blacklist_lines(df), f"{tmp_path}/list")
    names = sorted(n for n in os.listdir(f"{tmp_path}/list") if n.startswith("part-"))
    text = "".join((tmp_path / "list" / n).read_text() for n in names)
    groups = [sorted(p for i, p in entries if i == g) for g in sorted({i for i, _ in entries})]
    assert json.loads(text) == {"version": 1, "groups": groups}
    want = sorted((n, p) for n, g in enumerate(groups) for p in g)
    assert sorted(map(tuple, store.read_blacklist(spark, f"{tmp_path}/list").collect())) == want
    (tmp_path / "cut").mkdir()
    for k in range(4):  # as many tasks would leave it
        (tmp_path / "cut" / f"part-0000{k}.txt").write_text("\n".join(text.split("\n")[k * 80 : (k + 1) * 80]) + "\n")
    assert sorted(map(tuple, store.read_blacklist(spark, f"{tmp_path}/cut").collect())) == want
    for content in (json.dumps({"version": 1, "groups": groups}), json.dumps(groups)):
        (tmp_path / "one.json").write_text(content)
        assert sorted(map(tuple, store.read_blacklist(spark, f"{tmp_path}/one.json").collect())) == want
    items = spark.createDataFrame([(i % 5, i, None if i == 3 else f"n{i}") for i in range(200)] + [(1, 1, "n1")], "g int, i int, name string")
    store.write_lines(store.results_lines(items, ["g", "i"]), f"{tmp_path}/results")
    text = "".join((tmp_path / "results" / n).read_text() for n in sorted(os.listdir(f"{tmp_path}/results")) if n.startswith("part-"))
    assert [(r["g"], r["i"]) for r in json.loads(text)["items"]] == sorted((r.g, r.i) for r in items.collect())
    assert sorted(map(tuple, store.read_results(spark, f"{tmp_path}/results", "g:int, i:int, name:string").collect()), key=str) == sorted(map(tuple, items.collect()), key=str)
    store.write_lines(store.results_lines(items.limit(0), ["g"]), f"{tmp_path}/empty")
    assert store.read_results(spark, f"{tmp_path}/empty", "g:int").count() == 0


def test_report_survives_a_stop(spark, tmp_path):
    """A report that was moved aside when the writer stopped is there again after the next write failed, too."""
    a, path = spark.createDataFrame([("a",)], "value string"), f"{tmp_path}/report"
    store.write_report(a, path, "text")
    os.rename(path, f"{path}.old")
    with pytest.raises(Exception, match="kind|DATA_SOURCE|find"):
        store.write_report(a, path, "no-such-kind")
    assert [r.value for r in spark.read.text(path).collect()] == ["a"]
    store.write_report(spark.createDataFrame([("b",)], "value string"), path, "text")
    assert [r.value for r in spark.read.text(path).collect()] == ["b"] and sorted(os.listdir(tmp_path)) == ["report"]


def test_clip_groups(spark):
    """Clips that several sources contend for go to the first one; a source whose clips are all taken is in no group."""
    matches = [(0, "s0", "c10"), (0, "s0", "c11"), (1, "s1", "c10"), (1, "s1", "c11"), (2, "s2", "c10"), (2, "s2", "c12")]
    best, members = G.clip_groups(spark.createDataFrame(matches, "source_idx int, source string, clip string"))
    assert sorted(map(tuple, best.collect())) == [("s0", "c10"), ("s0", "c11"), ("s2", "c12")]
    assert sorted(map(tuple, members.collect())) == [("s0", "c10"), ("s0", "c11"), ("s0", "s0"), ("s2", "c12"), ("s2", "s2")]
    assert min(r["count"] for r in members.groupBy("group_id").count().collect()) == 2
    assert all(x.count() == 0 for x in G.clip_groups(spark.createDataFrame([], "source_idx int, source string, clip string")))


def test_joins_in_cells(spark):
    """One hot key is dealt to many tasks, whose rows are bounded; no pair is lost or made twice, equal rows count as often as they are there, and null keys meet nothing."""
    few = spark.range(3000).selectExpr("if(id % 10 = 0, id % 7, 1) as k", "id % 1500 as b").union(spark.sql("select cast(null as long), 5"))
    many = spark.range(40).selectExpr("id % 9 as k", "id as a").union(spark.sql("select cast(null as long), 5"))
    for cell in (None, 100):
        met = J._in_cells(many, few, ["k"], cell)
        want = many.join(few, "k").select("a", "b")
        assert sorted(map(tuple, met.select("a", "b").collect())) == sorted(map(tuple, want.collect()))
        parts = [r["count"] for r in met.where("k = 1").groupBy(F.spark_partition_id(), "cell_").count().collect()]
        assert len(parts) >= (25 if cell else 8) and max(parts) <= 5 * (2 * cell if cell else 512)
    files = spark.range(2000).selectExpr("id", "1000 + id % 3 as v")
    for df in (J.ratio_join(files, "id", "v", 20), J.containment_join(files.selectExpr("id", "v * (1 + id % 2) as v"), "id", "v", (1, 10), (95, 100))):
        assert df.groupBy(F.spark_partition_id()).count().count() > 2


def test_ratio_joins_at_their_bounds(spark):
    """Powers and products that lie on the bounds of buckets, zeros and nulls, against all pairs."""
    values = [None, 0, 1, 2, 4, 5, 8, 9, 10, 11, 64, 80, 95, 99, 100, 101, 125, 512, 640, 800, 999, 1000, 1001, 1250, 10_000, 8_000, 100_000, 10**9, 8 * 10**8]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long")
    pairs = [(i, x, j, y) for i, x in enumerate(values) for j, y in enumerate(values) if i != j and x and y]
    assert sorted(map(tuple, J.ratio_join(df, "id", "v", 20).collect())) == sorted((i, j) for i, x, j, y in pairs if i < j and abs(x - y) * 100 <= max(x, y) * 20)
    assert sorted(map(tuple, J.containment_join(df, "id", "v", (1, 10), (95, 100)).collect())) == sorted((i, j) for i, x, j, y in pairs if x * 10 >= y and x * 100 < y * 95)


def test_containment_takes_little_disk(spark, tmp_path):
    """What is written of the pairs is a small part of a byte each, as rows that meet the same sources come together."""
    files = spark.range(12_000).selectExpr("id * 7919 % 100003 as id", "cast(exp(3 + pmod(xxhash64(id), 4001) / 1000) as long) as v")
    J.containment_join(files, "id", "v", (1, 10), (95, 100)).write.parquet(str(tmp_path / "pairs"))
    v = np.sort([r.v for r in files.collect()])
    n = int((np.searchsorted(v, v * 10, "right") - np.searchsorted(v * 95, v * 100, "right")).sum())
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == n > 50_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * n


@pytest.mark.parametrize("cell", [None, 60])
def test_ratio_join_in_cells(spark, cell):
    """Cells of every size against all pairs: ids that repeat, null ids, ids that are strings or in the order of the values, values that are null."""
    rows = spark.range(1300).selectExpr("if(id % 50 = 0, null, concat('f', id % 900)) as id", "1 + id * id % 997 as v").union(spark.sql("select 'n', cast(null as bigint)")).coalesce(2)
    for df in (rows, spark.range(700).selectExpr("id - 300 as id", "1 + id as v")):
        got = Counter(map(tuple, J.ratio_join(df, "id", "v", 20, cell).collect()))
        r = [x for x in df.collect() if x.id is not None and x.v is not None]
        assert got == Counter((x.id, y.id) for x in r for y in r if x.id < y.id and abs(x.v - y.v) * 100 <= max(x.v, y.v) * 20)
        assert sum(got.values()) > 40_000


def test_ratio_join_takes_little_disk(spark, tmp_path):
    """What is written of the pairs is a small part of a byte each, as rows that meet the same ones come together."""
    files = spark.range(24_000).selectExpr("id * 7919 % 100003 as id", "cast(exp(5 + pmod(xxhash64(id), 2001) / 1000) as long) as v")
    J.ratio_join(files, "id", "v", 20).write.parquet(str(tmp_path / "pairs"))
    v = np.sort([r.v for r in files.collect()])
    n = int((np.searchsorted(v * 80, v * 100, "right") - np.arange(1, len(v) + 1)).sum())
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == n > 40_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * n


@pytest.mark.parametrize("cell", [None, 60])
def test_containment_in_cells(spark, cell):
    """Cells and ranges of every size against all pairs: rows that repeat, null ids, ids that are strings, double values, and a further key that may be null."""
    df = spark.range(1300).selectExpr("if(id % 50 = 0, null, concat('f', id % 900)) as id", "1 + id * id % 997 / 8D as v", "if(id % 11 = 0, null, id % 2) as k").union(spark.sql("select 'n', cast(null as double), 1")).coalesce(2)
    got = Counter((r.clip, r.source) for r in J.containment_join(df, "id", "v", (1, 10), (95, 100), ["k"], cell).collect())
    rows = [r for r in df.collect() if r.k is not None and r.v is not None]
    assert got == Counter((c.id, s.id) for c in rows for s in rows if c.k == s.k and c.v * 10 >= s.v and c.v * 100 < s.v * 95)
    assert sum(got.values()) > 100_000


def test_bm25(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = {i: [rng.choice(words) for _ in range(rng.randrange(1, 30))] for i in range(60)}
    asked = {"q1": ["w1", "w1", "w2"], "q2": ["w3", "nowhere"], "q3": ["nowhere"], "q4": words[:20]}
    mean, score = sum(map(len, docs.values())) / len(docs), {}
    for q, terms in asked.items():
        for i, d in docs.items():
            if set(terms) & set(d):
                df = {t: sum(t in x for x in docs.values()) for t in terms}
                score[q, i] = round(sum(np.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if t in d), 6)
    want = []
    for q in asked:
        best = sorted((i for p, i in score if p == q), key=lambda i: (-score[q, i], i))[:7]
        want += [(q, i, n + 1, score[q, i]) for n, i in enumerate(best)]
    texts = spark.createDataFrame([(i, ", ".join(d).upper()) for i, d in docs.items()] + [(None, "w1"), (99, None), (98, "")], "id int, t string")
    got = bm25_top(spark.createDataFrame([(q, "; ".join(t)) for q, t in asked.items()], "q string, t string"), "q", "t", bm25_index(texts, "id", "t"), 7)
    assert sorted((*r[:3], round(r[3], 5)) for r in map(tuple, got.collect())) == sorted((*r[:3], round(float(r[3]), 5)) for r in want)


def test_bm25_of_asked_words_only(spark):
    """Postings of the queries' words alone, with the weights that they have among all."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(3 + i))) for i in range(20)], "id int, t string")
    asked = spark.createDataFrame([("a", "w1 w2 W1"), ("b", "w5 nowhere")], "q string, t string")
    whole, few = bm25_index(docs, "id", "t"), bm25_index(docs, "id", "t", queries=asked)
    assert sorted(few.postings.collect()) == sorted(whole.postings.where("term in ('w1', 'w2', 'w5')").collect())
    assert few.postings.count() < whole.postings.count()
    assert sorted(bm25_top(asked, "q", "t", few).collect()) == sorted(bm25_top(asked, "q", "t", whole).collect())
