"""Groups from accepted pairs: ordered rounds over blocks, trees of parents, pruned components."""

from __future__ import annotations

from collections import defaultdict, deque
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.scalars import global_rank
from kindred.operators.graph import connected_components
from kindred.plans.scratch import Scratch


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, component) of the pairs (a, b)."""
    return connected_components(pairs, "a", "b")


_ROUND = "kind int, block long, r long, ga long, gb long, la long, lb long, sa boolean, sb boolean"


def _decide(limit: int):
    """One block's pairs in their order: those whose groups no earlier block and no waiting pair holds are decided. Gives the pairs that wait (kind 0) and what became of groups (kind 1: ga is now in gb, whose lead is la)."""

    def near(x: int | None, y: int | None) -> bool:
        return x is not None and y is not None and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= limit

    def run(table: pa.Table) -> pa.Table:
        columns = ("block", "r", "ga", "gb", "la", "lb", "sa", "sb", "mine_a", "mine_b")
        rows = sorted(zip(*[table.column(c).to_pylist() for c in columns]), key=lambda row: row[1])
        up: dict[int, int] = {}
        lead: dict[int, int | None] = {}
        single: dict[int, bool] = {}
        changed: set[int] = set()
        held: set[int] = set()
        out = []

        def top(x: int) -> int:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        for block, r, ga, gb, la, lb, sa, sb, mine_a, mine_b in rows:
            lead.setdefault(ga, la), single.setdefault(ga, sa)
            lead.setdefault(gb, lb), single.setdefault(gb, sb)
            x, y = top(ga), top(gb)
            if x == y:
                continue
            if not (mine_a and mine_b) or x in held or y in held:
                held |= {x, y}
                out.append((0, block, r, ga, gb, la, lb, sa, sb))
            elif single[x] and single[y]:
                single[x] = False
                up[y] = x
                changed |= {x, y}
            elif near(lead[x], lead[y]):
                x, y = (y, x) if single[x] else (x, y)
                up[y] = x
                changed.add(y)
        for x in changed:
            g = top(x)
            out.append((1, rows[0][0], 0, x, g, lead[g], None, False, False))
        names = [f.split()[0] for f in _ROUND.split(", ")]
        types = [pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return run


def _moved(open_: DataFrame, moves: DataFrame, side: str) -> DataFrame:
    """The pairs with the groups and leads that the moves gave one side."""
    now = moves.select(F.col("ga").alias("old"), F.col("gb").alias("now"), F.col("la").alias("lead"))
    hit = F.col("old").isNotNull()
    return open_.join(now, F.col(f"g{side}") == F.col("old"), "left").withColumns({f"g{side}": F.coalesce("now", f"g{side}"), f"l{side}": F.when(hit, F.col("lead")).otherwise(F.col(f"l{side}")), f"s{side}": F.col(f"s{side}") & ~hit}).drop("old", "now", "lead")


def constrained_groups(pairs: DataFrame, limit: int, block: int = 200_000) -> DataFrame:
    """(group_id, member) from pairs (a, b, ha, hb), in the order of (a, b): a file joins a group, or groups merge, only if their representatives' hashes are within the limit; two files in no group always form one, led by a.

    The result is that of a fold over all pairs one by one, without one task a component.
    Pairs are cut, by component and order, into blocks. A round decides, in all blocks at
    once, the pairs that are the first open ones of both their groups, counting what the
    block itself decided before them; the others wait for the next round with the groups
    that came of this one. The first open block always ends in its round, so there are no
    more rounds than blocks; components within a block take one. Pairs that fit one block
    need no components. Merged groups form trees, whose components are the final groups.

    block: pairs a task holds (up to twice as many where blocks shrank and were put together).
    Pairs with a null end or of a file with itself are ignored; a null hash is near nothing;
    a pair that repeats changes nothing. No pairs give no groups.
    """
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession)
    pairs = pairs.where("a is not null and b is not null and a <> b").select(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "ha", "hb")])
    pairs = scratch.save(pairs, "pairs")
    if pairs.count() <= block:
        ranked = pairs.withColumn("r", F.row_number().over(Window.orderBy("a", "b")))
    else:
        label = connected_components(pairs, "a", "b", scratch)
        by = pairs.join(label, F.col("a") == F.col("node")).select("component", "a", "b", "ha", "hb")
        ranked = global_rank(by, [F.col("component"), F.col("a"), F.col("b")], "r", int(spark.conf.get("spark.sql.shuffle.partitions")))
    yes = F.lit(True)
    open_ = ranked.select(F.floor((F.col("r") - 1) / block).alias("block"), F.col("r").cast("long").alias("r"), F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("ha").alias("la"), F.col("hb").alias("lb"), yes.alias("sa"), yes.alias("sb"))
    open_ = scratch.save(open_, "open")
    merged, rounds = pairs.select("a", "b").limit(0), 0
    while not open_.isEmpty():
        sizes = open_.groupBy("block").agg(F.count_if(F.lit(True)).alias("n"))
        together = sizes.select("block", F.floor((F.sum("n").over(Window.orderBy("block")) - 1) / block).alias("to"))
        now = open_.join(together, "block").withColumn("block", F.col("to")).drop("to")
        first = now.select(F.col("ga").alias("g"), "block").union(now.select("gb", "block")).groupBy("g").agg(F.min("block").alias("first"))
        for side in "ab":
            of = first.select(F.col("g").alias(f"g{side}"), F.col("first").alias(f"first_{side}"))
            now = now.join(of, f"g{side}").withColumn(f"mine_{side}", F.col(f"first_{side}") == F.col("block")).drop(f"first_{side}")
        done = scratch.save(now.groupBy("block").applyInArrow(_decide(limit), _ROUND), "round", by="kind")
        moves, wait = done.where("kind = 1"), done.where("kind = 0").drop("kind")
        merged = merged.union(moves.where("ga <> gb").select("ga", "gb"))
        left = scratch.save(_moved(_moved(wait, moves, "a"), moves, "b").where("ga <> gb"), "open")
        scratch.drop(open_)
        open_, rounds = left, rounds + 1
    if rounds == 1:
        least = moves.groupBy("gb").agg(F.min("ga").alias("group_id"))
        return moves.join(least, "gb").select("group_id", F.col("ga").alias("member"))
    forest = connected_components(merged, "a", "b", scratch)
    return forest.select(F.col("component").alias("group_id"), F.col("node").alias("member"))


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    links: dict[int, set[int]] = defaultdict(set)
    for a, b in pdf[["a", "b"]].itertuples(index=False):
        links[a].add(b)
        links[b].add(a)

    def prune(items: list[int]) -> tuple[list[int], list[int]]:
        inside, gone = set(items), []
        place = {x: i for i, x in enumerate(items)}
        degree = {x: len(links[x] & inside) for x in items}
        heap = [(degree[x], place[x]) for x in items]
        heapify(heap)
        while len(inside) >= 3:
            least, i = heappop(heap)
            x = items[i]
            if x not in inside or least != degree[x]:
                continue
            if least >= len(inside) // 2:
                break
            inside.discard(x)
            gone.append(x)
            for y in links[x] & inside:
                degree[y] -= 1
                heappush(heap, (degree[y], place[y]))
        return [x for x in items if x in inside], gone

    kept, gone = prune(sorted(links))
    groups = [kept] if len(kept) > 1 else []
    left, turn = set(gone), {x: i for i, x in enumerate(gone)}
    for x in gone:
        if x in left:
            part, queue = [], deque([x])
            left.discard(x)
            while queue:
                y = queue.popleft()
                part.append(y)
                for z in sorted(links[y] & left, key=turn.get):
                    left.discard(z)
                    queue.append(z)
            part = prune(part)[0]
            if len(part) > 1:
                groups.append(part)
    return pd.DataFrame([(min(g), x) for g in groups for x in g], columns=["group_id", "member"])


def split_chains(pairs: DataFrame) -> DataFrame:
    """(group_id, member): members that match fewer than half of the rest leave, the first of the least first; those that left form groups among themselves, gathered in the order in which they left.

    A component is held by one task, which takes its links' number times a logarithm of time.
    """
    label = connected_components(pairs, "a", "b")
    return pairs.join(label, F.col("a") == F.col("node")).select("a", "b", "component").groupBy("component").applyInPandas(_split, "group_id long, member long")


def timeline_groups(matches: DataFrame) -> DataFrame:
    """(group_id, member): in the order of (a, b), a match goes to the source's group, else the clip's, else a new one named by the source; members never move.

    A member's group is that of its partner in its first match, if the partner had one by
    then: a parent. Two for whom the match is the first form a group, whose root is the
    source. So groups are the trees of parents, and no group is folded in one task.
    """
    scratch = Scratch(matches.sparkSession)
    ends = matches.select(F.col("a").alias("node"), "a", "b").union(matches.select("b", "a", "b"))
    first = ends.groupBy("node").agg(F.min(F.struct("a", "b")).alias("m"))
    first = scratch.save(first.withColumn("other", F.when(F.col("node") == F.col("m.a"), F.col("m.b")).otherwise(F.col("m.a"))), "first")
    theirs = first.select(F.col("node").alias("other"), F.col("m").alias("theirs"))
    tree = scratch.save(first.join(theirs, "other").select("node", F.when(F.col("theirs") < F.col("m"), F.col("other")).otherwise(F.col("m.a")).alias("parent")), "parents")
    label = connected_components(tree, "node", "parent", scratch)
    label = tree.join(label.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "parent", F.coalesce("component", "node").alias("component"))
    root = label.where("node = parent").select("component", F.col("node").alias("group_id"))
    return label.join(root, "component").select("group_id", F.col("node").alias("member"))


def pair_clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, member): each pair puts both its files under the lesser of them. Clusters overlap and are no components."""
    key = F.least("a", "b").alias("cluster")
    return pairs.select(key, F.col("a").alias("member")).union(pairs.select(key, F.col("b").alias("member"))).distinct()


def clip_groups(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, members) of matches (source_idx, source, clip_idx, clip): a clip goes to its source of the least index, and a source that gets a clip makes a group of itself and its clips; a source whose clips all went elsewhere makes none.

    The least of each clip needs no order over all matches, so it is a partial aggregation.
    """
    best = matches.groupBy("clip").agg(F.min(F.struct("source_idx", "source")).alias("m")).select(F.col("m.source").alias("source"), "clip")
    members = best.select(F.col("source").alias("group_id"), F.col("clip").alias("member")).union(best.select("source", "source")).distinct()
    return best, members
