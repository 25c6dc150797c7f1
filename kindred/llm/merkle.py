"""A Merkle manifest of a table: one tree of digests per source, one over the sources, and a proof for every row.

Children are events. A task accumulates them into partial parents, keyed by (tree, level,
index), until a parent has as many as its tree's size gives it; then the parent's digest is
an event for its own parent, in the same task. Leaves come sorted, so all but the parents at
the edges of tasks are done at once. What is left, the unresolved children, is dealt out by
ancestor and combined again, until only roots are left. Every parent done leaves a link to
its children; from the roots down, the links give each block of leaves its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.line_dedup import ascii_lower
from kindred.plans.scratch import Scratch

ARITY = 16
_BITS = 4
_OPEN, _LINK, _ROOT = 0, 1, 2
#: kind: an unresolved child, a parent's link to its children (n: their number, data: their digests), or a root.
_EVENTS = "kind int, tree string, level int, idx long, n long, data binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values' length-prefixed UTF-8, null as '-'."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]), 256)


def _ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with idx (place within the tree, in the given order) and n (rows of the tree). Rows with equal order may swap places."""
    keys = ["tree", *order]
    spread = rows.withColumn("spread_", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))  # equal rows need not share a task
    line = spread.repartitionByRange(*keys, "spread_").sortWithinPartitions(*keys, "spread_").withColumn("at_", F.monotonically_increasing_id())
    line = scratch.save(line.drop("spread_").withColumn("part_", F.shiftright("at_", 33)), "sorted")
    held = line.groupBy("tree", "part_").agg(F.min("at_").alias("first_"), F.count_if(F.lit(True)).alias("m_"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m_").over(tree.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("tree").alias("tree_"), F.col("part_").alias("p_"), (before - F.col("first_")).alias("shift_"), F.sum("m_").over(tree).alias("n"))
    out = line.join(held, (F.col("tree") == F.col("tree_")) & (F.col("part_") == F.col("p_")))
    out = scratch.save(out.withColumn("idx", F.col("at_") + F.col("shift_")).drop("tree_", "p_", "shift_", "at_", "part_"), "ranked")
    scratch.drop(line)
    return out


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accumulate children into partial parents; emit links of parents that are complete, roots, and at the end the children that wait for others."""
    partial: dict[tuple[str, int, int], dict[int, bytes]] = {}
    sizes: dict[tuple[str, int, int], int] = {}
    names = ["kind", "tree", "level", "idx", "n", "data"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    for batch in batches:
        out: list[tuple] = []
        for event in zip(*[batch.column(c).to_pylist() for c in names[1:]]):
            tree, level, idx, n, digest = event
            while n > 1:
                key = (tree, level, idx >> _BITS)
                have = partial.setdefault(key, {})
                have[idx % ARITY] = digest
                arity = min(ARITY, n - key[2] * ARITY)
                if len(have) < arity:
                    sizes[key] = n
                    break
                del partial[key]
                sizes.pop(key, None)
                data = b"".join(have[i] for i in range(arity))
                out.append((_LINK, tree, level, key[2], arity, data))
                level, idx, n, digest = level + 1, key[2], -(-n // ARITY), hashlib.sha256(data.hex().encode()).digest()
            else:
                out.append((_ROOT, tree, level, idx, 1, digest))
        yield rows(out)
    yield rows([(_OPEN, tree, level, (parent << _BITS) + i, sizes[tree, level, parent], d) for (tree, level, parent), have in partial.items() for i, d in have.items()])


def grow(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of the trees over leaves (tree, idx, n, digest). Links: tree, level (of the children), idx (of the parent), n, data; roots: tree, level, data."""
    events = leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("n").cast("long").alias("n"), F.col("digest").alias("data"))
    done = []
    while True:
        out = scratch.save(events.mapInArrow(combine, _EVENTS), "combined")
        done.append(out)
        left = out.where(F.col("kind") == _OPEN)
        if left.isEmpty():
            break
        # Two levels a round: children and grandchildren of a node meet in one task.
        top = F.floor(F.col("level") / 2).cast("int") * 2 + 2
        block = F.expr(f"shiftright(idx, {_BITS} * (2 - level % 2))")
        spread = left.select("tree", "level", "idx", "n", "data", top.alias("top_"), block.alias("block_")).repartition("tree", "top_", "block_")
        events = spread.drop("top_", "block_")
    every = reduce(DataFrame.union, done)
    return every.where(F.col("kind") == _LINK).drop("kind"), every.where(F.col("kind") == _ROOT).select("tree", "level", "data")


def descend(starts: DataFrame, links: DataFrame, down_to: int) -> DataFrame:
    """(tree, level, idx, up) of the nodes of level down_to, and of the starts below it. up: from the node's level to the root, each run as place, number and digests.

    starts: tree, level, idx, up.
    """
    top = starts.agg(F.max("level").alias("m")).first()["m"] or 0
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    at = starts.where(F.col("level") == top) if top > down_to else starts.where(F.col("level") <= down_to)
    for level in range(top, down_to, -1):
        run = links.where(F.col("level") == level - 1).select(F.col("tree").alias("t_"), F.col("idx").alias("i_"), F.col("n").alias("n_"), "data")
        met = at.join(run, (F.col("tree") == F.col("t_")) & (F.col("idx") == F.col("i_")))
        met = met.select("tree", "idx", "n_", "data", "up", F.explode(F.sequence(F.lit(0), (F.col("n_") - 1).cast("int"))).alias("place_"))
        at = met.select("tree", F.lit(level - 1).alias("level"), (F.col("idx") * ARITY + F.col("place_")).alias("idx"), F.concat(byte(F.col("place_")), byte(F.col("n_")), "data", "up").alias("up"))
        at = at.union(starts.where(F.col("level") == level - 1) if level - 1 > down_to else starts.where(F.col("level") <= down_to))
    return at


def _parse(up: bytes) -> list[tuple[int, str]]:
    """(place, digests as hex) of each run of a path."""
    out, i = [], 0
    while i < len(up):
        place, n = up[i], up[i + 1]
        out.append((place, up[i + 2 : i + 2 + 32 * n].hex()))
        i += 2 + 32 * n
    return out


def _beside(place: int, run: str) -> tuple[str, str]:
    """What stands before and after a digest in its run."""
    return run[: 64 * place], run[64 * place + 64 :]


def _prove(leaves: pa.Table, links: pa.Table) -> pa.Table:
    """Proofs of a block of leaves; links: the runs of its two lowest levels, and its node's path with the subroot before it (level -1)."""
    runs, up, subroot = {}, [], ""
    for level, idx, data in zip(*[links.column(c).to_pylist() for c in ("level", "idx", "data")]):
        if level < 0:
            subroot, up = data[:32].hex(), [_beside(*x) for x in _parse(data[32:])]
        else:
            runs[level, idx] = data.hex()
    rest = "".join(a + b for a, b in up)
    digests, proofs, folded = [], [], []
    for idx, leaf, forged in zip(*[leaves.column(c).to_pylist() for c in ("idx", "digest", "forged")]):
        own = [_beside((idx >> (_BITS * k)) % ARITY, runs[k, idx >> (_BITS * (k + 1))]) for k in (0, 1) if (k, idx >> (_BITS * (k + 1))) in runs]
        proofs.append(hashlib.sha256(("".join(a + b for a, b in own) + rest).encode()).hexdigest())
        node = (leaf if forged is None else forged).hex()
        for a, b in own + up:
            node = hashlib.sha256((a + node + b).encode()).hexdigest()
        digests.append(leaf.hex())
        folded.append(node)
    cols = [leaves.column("doc_id"), pa.array(digests), pa.array([subroot] * len(digests)), pa.array(proofs), pa.array(folded)]
    return pa.table(cols, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, tampered: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of FIELDS. Per source they ascend by doc_id, and every 16 consecutive
    nodes become their digest until one is left, the source's subroot (a lone leaf itself);
    subroots by source become the root likewise. The proof is all siblings on the way from
    the leaf to the root; folded_root is computed from the leaf and the proof, and verified
    says whether it is the root. tampered: the text that is presented instead of the row's
    own when the proof is folded (default: the own one).

    docs needs FIELDS; other columns are not read. Null and empty values have digests of
    their own; a null source is a source, the first; null ids come first in their source,
    and rows with equal ids are ordered by their digests, so rows that repeat have leaves
    each, side by side. An empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = [F.col(c) for c in FIELDS]
    forged = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(F.col("text")), F.unhex(leaf_digest([*own[:-1], tampered])))
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # sorts as sources do, null first
    leaves = _ranked(docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf_digest(own)).alias("digest"), forged.alias("forged")), ["doc_id", "digest"], scratch)
    links, subroots = grow(leaves, scratch)
    subroots = scratch.save(subroots, "subroots")
    tops = _ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("data").alias("digest")), ["of"], scratch)
    top_links, root = grow(tops, scratch)
    first = root.first()
    start = root.select("tree", "level", F.lit(0).cast("long").alias("idx"), F.lit(b"").alias("up"))
    paths = descend(start, top_links, 0).select(F.col("idx").alias("i_"), "up")
    paths = tops.select("of", "idx").join(paths, F.col("idx") == F.col("i_")).select("of", "up")
    starts = subroots.join(paths, F.col("tree") == F.col("of")).select("tree", "level", F.lit(0).cast("long").alias("idx"), "up")
    nodes = descend(scratch.save(starts, "starts"), links, 2)
    ends = nodes.join(subroots.select(F.col("tree").alias("of"), F.col("data").alias("sub")), F.col("tree") == F.col("of"))
    ends = ends.select("tree", F.col("idx").alias("block"), F.lit(-1).alias("level"), "idx", F.concat("sub", "up").alias("data"))
    low = links.where("level < 2").select("tree", F.expr(f"shiftright(idx, {_BITS} * (1 - level))").alias("block"), "level", "idx", "data")
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = leaves.select("tree", F.shiftright("idx", 2 * _BITS).alias("block"), "idx", "doc_id", "digest", "forged").groupBy("tree", "block")
    proven = blocks.cogroup(low.union(ends).groupBy("tree", "block")).applyInArrow(_prove, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = F.lit(bytes(first["data"]).hex() if first else None).cast("string")
    return proven.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def lower_some(docs: DataFrame, one_in: int = 5) -> Column:
    """The text with A-Z lower-cased where one_in divides the CRC-32 of the decimal doc_id, else as it is."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % one_in == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))


def merkle_sql(levels: int = 7) -> str:
    """manifest(documents, lower_some(documents)) in DuckDB's SQL, for up to 16**levels rows a source and as many sources."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join([*[field(c) for c in FIELDS[:-1]], field(text)]) + ")"
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    for_bits = f"list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: {step})"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda crc, b: {for_bits}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""
WITH d AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE text END AS forged FROM documents),
e AS (SELECT row_number() OVER () AS rid, doc_id, source, {digest('text')} AS leaf, {digest('forged')} AS forged FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx FROM e),
a0 AS (SELECT source AS tree, idx, leaf AS digest FROM leaves)"""
    run = "string_agg(digest, '' ORDER BY idx)"

    def climb(name: str) -> str:
        parts = ""
        for k in range(levels):
            node = f"CASE WHEN any_value(n) > 1 THEN sha256({run}) ELSE any_value(digest) END"
            parts += f""",
{name}r{k} AS (SELECT tree, idx // 16 AS idx, any_value(n) AS n, {run} AS run, {node} AS digest FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY tree, idx // 16),
{name}{k + 1} AS (SELECT tree, idx, digest FROM {name}r{k})"""
        return parts

    out += climb("a")
    out += f""",
subs AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS turn FROM a{levels}),
b0 AS (SELECT 0 AS tree, turn AS idx, subroot AS digest FROM subs)"""
    out += climb("b")
    out += f""",
f0 AS (SELECT l.doc_id, l.leaf, l.forged AS node, '' AS proof, l.source, l.idx, s.subroot, s.turn, (SELECT digest FROM b{levels}) AS root FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source)"""
    at = 0
    for name, tree, idx in (("a", "f.source", "idx"), ("b", "0", "turn")):
        for k in range(levels):
            mine = f"f.{idx} // {16 ** k}"
            before, after = f"substr(r.run, 1, 64 * CAST(({mine}) % 16 AS INT))", f"substr(r.run, 64 * CAST(({mine}) % 16 AS INT) + 65)"
            out += f""",
f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN r.n > 1 THEN sha256({before} || node || {after}) ELSE node END AS node, CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof)
  FROM f{at} f JOIN {name}r{k} r ON r.tree IS NOT DISTINCT FROM {tree} AND r.idx = f.{idx} // {16 ** (k + 1)})"""
            at += 1
    return out + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{at}"""


MERKLE_SQL = merkle_sql()
