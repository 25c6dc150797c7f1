"""Queries over all rows and whole series: against brute force, or against their SQL without the cuts in it."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_registry import TABLES, plain

from kindred.plans import registry
from kindred.sources.catalog import view

MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with the events, and those of 20 users again from the fourth on, one in nine of another type, as other users'."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{MORE}/events.parquet")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    again = e.withColumn("place", place).where("user_id between 30 and 49 and place > 3")
    again = again.withColumn("event_type", F.when(F.col("place") % 9 == 0, "view").otherwise(F.col("event_type"))).withColumn("user_id", (F.col("user_id") + 1000).cast(e.schema["user_id"].dataType))
    e.unionByName(again.drop("place")).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def users(spark, events):
    """Blocks by user: more users than 24 and more points than 12."""
    out = {}
    for r in view(spark, events, "points").select("user_id", "pos", "block").orderBy("user_id", "pos").collect():
        out.setdefault(r.user_id, []).append(r.block)
    assert len(out) > 24 and max(map(len, out.values())) > 12
    return out


def run(spark, name, folder):
    return registry.QUERIES[name](spark, folder).collect()


def clips(users):
    order = sorted(users, key=lambda u: (len(users[u]), u))
    return [(c, s) for i, c in enumerate(order) for s in order[i + 1 :]]


def test_audio_window(spark, users, events):
    want = {}
    for c, s in clips(users):
        a, b = users[c], users[s]
        bits, pos = min((sum((x ^ y).bit_count() for x, y in zip(a, b[o:])), o) for o in range(len(b) - len(a) + 1))
        if bits * 100 <= len(a) * 32 * 30:
            want[c, s] = bits, pos
    assert len(want) >= 20
    assert {(r.clip, r.source): (r.bits, r.pos) for r in run(spark, "ARR1_JN6_audio_window", events)} == want


def test_timeline_join(spark, users, events):
    def scan(a, b, o):
        match = run_ = gap = best = miss = 0
        for x, y in zip(a, b[o:]):
            if (x ^ y).bit_count() <= 9:
                match, run_, gap = match + 1, run_ + 1, 0
                best = max(best, run_)
            else:
                miss += 1
                run_, gap = (run_ + 1, gap + 1) if gap < 1 else (0, 0)
                if miss > -(-len(a) * (1.0 - 0.699999988079071) // 1):
                    break
        return match, best, -o

    want = {}
    for c, s in clips(users):
        match, best, back = max(scan(users[c], users[s], o) for o in range(len(users[s]) - len(users[c]) + 1))
        if match * 2 >= len(users[c]) >= 2:
            want[c, s] = match, best, -back
    assert len(want) >= 20
    assert {(r.clip, r.source): (r.match, r.run, r.pos) for r in run(spark, "ARR2_JN7_timeline_join", events)} == want


def test_common_prefix(spark, users, events):
    got = {(r.a, r.b): r.sim for r in run(spark, "SIM10_SIM6_prefix_similarity", events)}
    ids = sorted(users)
    assert set(got) == {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    for (a, b), sim in got.items():
        n = min(len(users[a]), len(users[b]))
        assert sim == pytest.approx(1 - sum((x ^ y).bit_count() for x, y in zip(users[a], users[b])) / (n * 32), abs=1e-8)


def test_silent(spark, users, events):
    assert {r.user_id: r.silent for r in run(spark, "AGG14_silent", events)} == {u: all(x in (0, 65535) for x in b) for u, b in users.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{MORE}/{t}.parquet'")
    return c


def both(spark, con, name):
    """The query's rows and those of its SQL, in order."""
    sql = registry.ORACLE_SQL[name]
    df = registry.QUERIES[name](spark, MORE)
    cur = con.execute(sql)
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    return [[plain(v) for v in r] for r in df.collect()], [[plain(r[i]) for i in at] for r in cur.fetchall()]


@pytest.mark.parametrize("name", ["SIM1_frame_difference", "SIM2_masked_difference", "SIM3_decision", "SIM5_flipped", "AGG12_too_dark", "ARR9_flip"])
def test_all_vectors(spark, con, name):
    got, want = both(spark, con, name)
    assert len(got) > 400 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_same_folder(spark, con):
    got, want = both(spark, con, "FLT10_same_folder_at_depth")
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[0] % 3 for r in got)


def test_delete_identical(spark):
    """All but the keeper of the groups that are all alike (those that end in 1), odd items too; none of the others."""
    groups = {}
    for r in view(spark, MORE, "members").collect():
        groups.setdefault(r.group_id, []).append((-r.size_bytes, r.item_id))
    want = {(g, i) for g, m in groups.items() if g.endswith("1") for _, i in sorted(m)[1:]}
    got = [tuple(r) for r in registry.QUERIES["WIN5_delete_identical"](spark, MORE).select("group_id", "item_id").collect()]
    assert len(got) == len(want) and set(got) == want and {g for g, _ in want} < set(groups)


@pytest.mark.parametrize("name", [f"ORD1_ORD2_{c}_{d}" for c in ("size", "resolution", "duration", "date", "similarity") for d in ("asc", "desc")])
def test_whole_sorts(spark, con, name):
    got, want = both(spark, con, name)
    assert len(got) > 100 and got == want
