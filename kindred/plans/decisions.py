"""Queries of scan settings, duplicate decisions, identities and group sorts, with their SQL. Registered by registry.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.presets import history, presets
from kindred.operators import kernels as K
from kindred.operators import ranking as R
from kindred.plans.registry import _PIX, L, pixels, query, signs
from kindred.sources import store
from kindred.sources.eligibility import ScanSettings, comparable, scan_reasons

SETTINGS = ScanSettings(
    included=("/lib/src1", "/lib/src2", "/lib/src3", "/lib/src4", "/lib/src5"), excluded=("/LIB/SRC3", "d6*"), images=False,
    sizes=(200, 20000), must_match=("*.MKV", "*.mp?"), must_not_match=("*9.mkv",),
)
_INCLUDED = " OR ".join(f"starts_with(folder, '{f}/')" for f in SETTINGS.included)


@query("FLT1_scan_reasons", f"""SELECT file_id, CASE WHEN is_image THEN 'images off' WHEN starts_with(folder, '/lib/src3/') OR ends_with(folder, '/d6') THEN 'excluded folder' WHEN NOT ({_INCLUDED}) THEN 'not included'
  WHEN (flags & 1) > 0 THEN 'manual' WHEN (flags & 2) > 0 THEN 'too dark' WHEN file_id % 19 = 0 THEN 'missing' WHEN file_id % 23 = 0 THEN 'unsafe path' WHEN size_bytes NOT BETWEEN 200 AND 20000 THEN 'size'
  WHEN NOT regexp_matches(path, '\\.(mkv|mp.)$') THEN 'lacks pattern' WHEN file_id % 11 = 0 THEN 'link' WHEN ends_with(path, '9.mkv') THEN 'has pattern' END AS reason FROM files""", "files")
def reasons(files: DataFrame) -> DataFrame:
    """Every 19th file isn't on disk, every 11th is a link, and the paths of every 23rd end in half a surrogate pair."""
    broken = F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("EDA0BD"))).cast("string")
    files = files.withColumn("path", F.when(F.col("file_id") % 23 == 0, broken).otherwise(F.col("path")))
    listing = files.where("file_id % 19 <> 0").select("path", (F.col("file_id") % 11 == 0).alias("is_link"))
    return scan_reasons(files, listing, SETTINGS).select("file_id", "reason")


@query("FLT9_comparable", "SELECT file_id FROM files f LEFT JOIN labels l ON l.doc_id = f.file_id WHERE f.file_id % 16 < 4 AND coalesce(l.toxic, 0) = 0 AND l.quality IS NOT NULL AND (is_image OR (SELECT count(*) FROM points p WHERE p.user_id = f.file_id) >= 5)", "files", "@labels", "points")
def can_compare(files: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """Labels stand for probe results, the points of a user for the samples of the file with its number."""
    probed = labels.select(F.col("doc_id").alias("file_id"), (F.col("quality").isNotNull()).alias("has_info"), (F.col("toxic") == 1).alias("invalid"))
    files = files.join(probed, "file_id", "left").withColumn("failed", F.col("flags").bitwiseAND(12) > 0)
    return comparable(files, points.select(F.col("user_id").alias("file_id")), 5).select("file_id")


_FRAMES = f"SELECT vec_id, list_transform(range(4), lambda k: f[k * 16 + 1 : k * 16 + 16]) AS fs FROM ({_PIX})"
_DIFF = "list_sum(list_transform(range(1, 5), lambda k: list_sum(list_transform(range(1, 17), lambda i: abs(x.fs[k][i] - y.fs[k][i]))))) / 16.0 :: DOUBLE / 256"


@query("SIM3_video_decision", f"SELECT a, d <= 4 * 0.0625 :: DOUBLE AS dup, CASE WHEN d <= 4 * 0.0625 :: DOUBLE THEN d / 4 END AS diff FROM (SELECT x.vec_id AS a, {_DIFF} AS d FROM ({_FRAMES}) x JOIN ({_FRAMES}) y ON y.vec_id = x.vec_id + 1)", "@embeddings")
def video(e: DataFrame) -> DataFrame:
    """A vector as four frames of 16 pixels, against the next one's."""
    fs = pixels(e).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("f", k * 16 + 1, F.lit(16))).alias("fs"))
    next_ = fs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fs").alias("ys"))
    return fs.join(next_, "vec_id").select(F.col("vec_id").alias("a"), K.video_decision(F.col("fs"), F.col("ys"), 0.0625).alias("d")).select("a", "d.dup", "d.diff")


_BITS = "SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN list_sum(list_transform(range(1, 61), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT END AS h FROM embeddings"


@query("SIM3_hash_decision", f"SELECT x.vec_id AS a, coalesce(bit_count(xor(x.h, y.h)) <= 25, false) AS dup, coalesce(bit_count(xor(x.h, y.h)) / 64.0 :: DOUBLE, 1) AS diff FROM ({_BITS}) x JOIN ({_BITS}) y ON y.vec_id = x.vec_id + 1", "@embeddings")
def hashes(e: DataFrame) -> DataFrame:
    """Signs of a vector as the hash of its first position, against the next one's; every seventh has none."""
    h = signs(e).withColumn("hash", F.when(F.col("id") % 7 != 0, F.col("hash")))
    next_ = h.select((F.col("id") - 1).alias("id"), F.col("hash").alias("other"))
    return h.join(next_, "id").select(F.col("id").alias("a"), K.hash_decision(F.col("hash"), F.col("other"), 0.6).alias("d")).select("a", "d.dup", "d.diff")


_SERIES = "SELECT user_id, list(block ORDER BY pos) AS b, list(block >> 16 ORDER BY pos) AS f FROM points GROUP BY user_id"
_MEAN = "list_sum(list_transform(range(1, least(len(x.b), len(y.b)) + 1), lambda k: 1 - bit_count(xor(x.{0}[k], y.b[k])) / 64.0 :: DOUBLE)) / least(len(x.b), len(y.b))"


@query("SIM6_match_or_flip", f"SELECT a, b, CASE WHEN p >= 0.8 THEN 'plain' WHEN q >= 0.8 THEN 'flip' END AS method, CASE WHEN p >= 0.8 THEN round(p, 9) WHEN q >= 0.8 THEN round(q, 9) END AS sim FROM (SELECT x.user_id AS a, y.user_id AS b, {_MEAN.format('b')} AS p, {_MEAN.format('f')} AS q FROM ({_SERIES}) x JOIN ({_SERIES}) y ON y.user_id = x.user_id + 1)", "points")
def flip(points: DataFrame) -> DataFrame:
    """Each user's blocks against those of the next; the upper halves of blocks stand for flipped hashes."""
    both = points.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("s")).select("user_id", F.transform("s", lambda x: x.block).alias("b"), F.transform("s", lambda x: F.shiftright(x.block, 16)).alias("f"))
    next_ = both.select((F.col("user_id") - 1).alias("user_id"), F.col("b").alias("other"))
    return both.join(next_, "user_id").select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"), K.match_or_flip(F.col("b"), F.col("f"), F.col("other"), 0.8).alias("m")).select("a", "b", "m.method", F.round("m.sim", 9).alias("sim"))


_STREAMS = "CAST(item_id % 2 AS STRING) AS format, CASE WHEN item_id % 3 > 0 THEN 'aac' END AS audio_format, 'stereo' AS audio_channel"
_COPIES = f"(SELECT *, {_STREAMS} FROM members UNION ALL SELECT * REPLACE (item_id + 100000000 AS item_id, size_bytes + item_id % 8 AS size_bytes), {_STREAMS} FROM members WHERE item_id % 4 = 0)"


def with_copies(members: DataFrame) -> DataFrame:
    """Every fourth member has a copy, which is larger for half of them."""
    members = members.withColumns({"format": (F.col("item_id") % 2).cast("string"), "audio_format": F.when(F.col("item_id") % 3 > 0, "aac"), "audio_channel": F.lit("stereo")})
    copies = members.where("item_id % 4 = 0").withColumns({"size_bytes": F.col("size_bytes") + F.col("item_id") % 8, "item_id": F.col("item_id") + 100000000})
    return members.union(copies)


for _name, _fields in R.IDENTITIES.items():
    query(f"FLT21_{_name}", f"SELECT group_id, item_id, n_same FROM (SELECT group_id, item_id, count(*) OVER (PARTITION BY {', '.join(['group_id', *_fields])}) - 1 AS n_same FROM {_COPIES}) WHERE n_same > 0", "members")(
        lambda m, n=_name: R.identical(with_copies(m), n).select("group_id", "item_id", L("n_same").alias("n_same")))

for _key, _value in {"size": "count(*) OVER g", "total": "CAST(sum(size_bytes) OVER g AS BIGINT)", "checked": "bool_or(checked) OVER g"}.items():
    for _d in ("asc", "desc"):
        query(f"ORD1_group_{_key}_{_d}", f"SELECT group_id, item_id, {_value} AS v FROM members WINDOW g AS (PARTITION BY group_id) ORDER BY v {_d}, group_id, item_id", "members")(
            lambda m, k=_key, d=_d: R.group_order(m, k, d == "desc").select("group_id", "item_id", "v"))


_EXPRESSION = "concat('size_bytes > ', CAST(event_id % 4 AS STRING))"
_LOG = f"SELECT user_id AS owner, CASE event_type WHEN 'error' THEN 'delete' ELSE 'save' END AS action, concat('p', CAST(event_id % 3 AS STRING)) AS name, {_EXPRESSION} AS expression, event_id FROM {{0}}"
_log = lambda e: e.selectExpr("user_id as owner", "CASE event_type WHEN 'error' THEN 'delete' ELSE 'save' END AS action", "concat('p', CAST(event_id % 3 AS STRING)) AS name", f"{_EXPRESSION} AS expression", "event_id")
query("UDF3_presets", f"WITH l AS ({_LOG.format('events')}), d AS (SELECT owner, name, max(event_id) AS gone FROM l WHERE action = 'delete' GROUP BY ALL) SELECT l.owner, l.name, arg_max(expression, event_id) AS expression, min(event_id) AS added FROM l LEFT JOIN d ON d.owner IS NOT DISTINCT FROM l.owner AND d.name = l.name WHERE action = 'save' AND (gone IS NULL OR event_id > gone) GROUP BY l.owner, l.name", "@events")(
    lambda e: presets(_log(e), ["event_id"]).withColumn("added", F.col("added.event_id")))
query("UDF3_expression_history", f"SELECT owner, expression, max(event_id) AS used FROM ({_LOG.format('events')}) GROUP BY owner, expression ORDER BY owner NULLS FIRST, used DESC", "@events")(
    lambda e: history(_log(e), ["event_id"]).withColumn("used", F.col("used.event_id")).orderBy("owner", F.desc("used")))

_LABEL = "CASE p.method WHEN 'FrameSimilarity' THEN 'frame' WHEN 'AudioMatch' THEN 'audio' WHEN 'TimelineMatch' THEN 'timeline' END"
query("SNK7_pair_text", f"SELECT p.file_a, p.file_b, concat('  [', printf('%.1f', sim / 10.0), '% via ', {_LABEL}, CASE WHEN clip_offset % 5 > 0 THEN concat('  offset ', printf('%.1f', CAST(clip_offset AS DOUBLE)), 's') ELSE '' END, ']', chr(10), '    A: ', coalesce(a.path, '?'), chr(10), '    B: ', coalesce(b.path, '?'), chr(10)) AS text FROM pairs p LEFT JOIN files a ON a.file_id = p.file_a AND a.file_id % 9 <> 0 LEFT JOIN files b ON b.file_id = p.file_b AND b.file_id % 9 <> 0", "pairs", "files")(
    lambda p, f: store.pair_text(p.withColumn("clip_offset", F.when(F.col("clip_offset") % 5 > 0, F.col("clip_offset"))), f.where("file_id % 9 <> 0")))
