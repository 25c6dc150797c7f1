"""All registered queries and their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import grouping as G
from kindred.operators import joins as J
from kindred.operators import kernels as K
from kindred.operators import ranking as R
from kindred.operators import series as X
from kindred.plans.scratch import Scratch
from kindred.sources import store
from kindred.sources.catalog import table, view, with_views
from kindred.sources.probe import media_info

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *needs: str):
    """Register f(spark, *frames) under name; needs are views or tables (tables with a leading '@')."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, n[1:]) if n[0] == "@" else view(spark, sf_dir, n) for n in needs])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


one = lambda: F.count_if(F.lit(True))
L = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
BI = "CAST({} AS BIGINT)".format


def _through_lines(lines: DataFrame, read, *more: str) -> DataFrame:
    """What reading gives of lines that were written as text files."""
    path = f"{Scratch(lines.sparkSession).root}/lines"
    store.write_lines(lines, path)
    return read(lines.sparkSession, path, *more)


def _next_group(groups: DataFrame) -> DataFrame:
    """The group after each, the first after the last: by ranks over all groups and a join on the next one."""
    ranked = Scratch(groups.sparkSession).save(S.global_rank(groups, [F.col("group_id")], "r"), "ranked")
    last = F.broadcast(ranked.agg(F.max("r").alias("last")))
    return ranked.crossJoin(last).withColumn("r", F.col("r") % F.col("last") + 1).drop("last").join(ranked.select("r", F.col("group_id").alias("next")), "r").select("group_id", "next")


def _clips(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs as matches of the longer file, the source, and the other one; sources by falling length."""
    side = lambda s: files.select(F.col("file_id").alias(f"file_{s}"), F.col("duration").alias(s))
    met = pairs.join(side("a"), "file_a").join(side("b"), "file_b")
    first = F.col("a") >= F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(F.struct((-F.greatest("a", "b")).alias("secs"), pick("file_a", "file_b").alias("id")).alias("source_idx"), pick("file_a", "file_b").alias("source"), pick("file_b", "file_a").alias("clip"))


# ---- 2.1 sources and sinks
query("SRC3_SRC4_media_type", "SELECT file_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'mkv' THEN 'video' WHEN 'mp3' THEN 'audio' ELSE 'unknown' END AS media FROM files", "files")(
    lambda f: f.select("file_id", S.extension("path").alias("ext"), S.media_type("path").alias("media")))
query("SRC10_probe_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "@events")(
    lambda e: e.select("event_id", F.from_json("props", "k long")["k"].alias("k")))
query("SRC12_exif_date", "SELECT doc_id, epoch(strptime(s, '%Y:%m:%d %H:%M:%S'))::BIGINT AS taken FROM (SELECT doc_id, concat(CAST(2000 + doc_id % 20 AS STRING), ':', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), ':', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), ' 10:00:07') AS s FROM documents) t", "@documents")(
    lambda d: d.select("doc_id", S.exif_time(F.concat((2000 + F.col("doc_id") % 20).cast("string"), F.lit(":"), F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0"), F.lit(":"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0"), F.lit(" 10:00:07"))).alias("taken")))
query("SNK6_group_report", "SELECT concat_ws(',', group_id, CAST(item_id AS STRING), concat('\"', replace(path, '\"', '\"\"'), '\"'), CAST(size_bytes AS STRING), CAST(sim AS STRING)) AS line FROM members", "members")(
    lambda m: m.select(F.concat_ws(",", "group_id", F.col("item_id").cast("string"), S.csv_quote(F.col("path"), always=True), F.col("size_bytes").cast("string"), F.col("sim").cast("string")).alias("line")))
query("SNK7_pair_report", "SELECT p.file_a, p.file_b, a.path AS path_a, b.path AS path_b, p.sim, CASE p.method WHEN 'FrameSimilarity' THEN 'frame' WHEN 'AudioMatch' THEN 'audio' WHEN 'TimelineMatch' THEN 'timeline' END AS label FROM pairs p LEFT JOIN files a ON a.file_id = p.file_a LEFT JOIN files b ON b.file_id = p.file_b", "pairs", "files")(
    lambda p, f: p.join(f.select(F.col("file_id").alias("file_a"), F.col("path").alias("path_a")), "file_a", "left").join(f.select(F.col("file_id").alias("file_b"), F.col("path").alias("path_b")), "file_b", "left").select("file_a", "file_b", "path_a", "path_b", "sim", S.method_label("method").alias("label")))

_CSV = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') ELSE {c} END"
_EXT = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"
query("SNK6_group_csv", "SELECT concat_ws(',', group_id, printf('%.1f', sim / 10.0), " + _CSV("path") + ", CAST(size_bytes AS STRING), printf('%.3f', CAST(duration AS DOUBLE)), CAST(frame_size AS STRING), " + _EXT + ", printf('%.2f', CAST(fps AS DOUBLE)), CAST(bitrate AS STRING), CAST(audio_rate AS STRING), strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), CASE WHEN is_image THEN 'True' ELSE 'False' END, CAST(flags AS STRING), '0') AS line FROM members", "members")(lambda m: store.csv_lines(store.group_report(m)))
query("SNK7_pair_csv", "SELECT concat_ws(',', printf('%.4f', sim / 1000.0), CASE p.method WHEN 'FrameSimilarity' THEN 'frame' WHEN 'AudioMatch' THEN 'audio' WHEN 'TimelineMatch' THEN 'timeline' END, printf('%.3f', CAST(clip_offset AS DOUBLE)), " + _CSV("a.path") + ", CAST(a.size_bytes AS STRING), printf('%.3f', CAST(a.duration AS DOUBLE)), CAST(a.width AS STRING), CAST(a.height AS STRING), " + _CSV("b.path") + ", CAST(b.size_bytes AS STRING), printf('%.3f', CAST(b.duration AS DOUBLE)), CAST(b.width AS STRING), CAST(b.height AS STRING)) AS line FROM pairs p JOIN files a ON a.file_id = p.file_a JOIN files b ON b.file_id = p.file_b", "pairs", "files")(lambda p, f: store.csv_lines(store.pair_report(p, f)))
query("SRC8_SNK4_blacklist_round_trip", "SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY entry_id) - 1 AS INT) AS entry_id, path FROM blacklist", "blacklist")(lambda b: _through_lines(store.blacklist_lines(b), store.read_blacklist))
query("SRC7_SNK3_results_round_trip", "SELECT item_id, group_id, sim FROM members", "members")(lambda m: _through_lines(store.results_lines(m.select("item_id", "group_id", "sim"), ["group_id", "item_id"]), store.read_results, "item_id:bigint, group_id:string, sim:bigint"))
_PROBE = lambda f: f.select("file_id", F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"), "width", "height", F.concat(F.col("fps").cast("string"), F.lit("/1")).alias("r_frame_rate"), F.when(F.col("file_id") % 2 == 0, F.col("bit_rate").cast("string")).alias("bit_rate"), F.when(F.col("flags") > 8, "smpte2084").alias("color_transfer"))).alias("streams"), F.struct(F.concat(F.col("duration").cast("string"), F.lit(".75")).alias("duration"), F.lit("777").alias("bit_rate")).alias("format"))).alias("j"))
query("SRC10_SCL4_media_info", "SELECT file_id, duration, width, height, CAST(fps AS FLOAT) AS frame_rate, CASE WHEN file_id % 2 = 0 THEN bit_rate ELSE 777 END AS bit_rate, CASE WHEN flags > 8 THEN 'HDR10' END AS hdr_format FROM files", "files")(
    lambda f: _PROBE(f).withColumn("i", media_info("j")).select("file_id", "i.duration", F.element_at("i.streams", 1).alias("s")).select("file_id", "duration", "s.width", "s.height", "s.frame_rate", "s.bit_rate", "s.hdr_format"))
query("SCL13_byte_range", "SELECT file_id, CASE WHEN lo <= hi THEN lo END AS start, CASE WHEN lo <= hi THEN hi END AS stop FROM (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN greatest(size_bytes - 100, 0) ELSE file_id END AS lo, CASE WHEN file_id % 3 = 1 THEN least(file_id + 50, size_bytes - 1) ELSE size_bytes - 1 END AS hi FROM files) t", "files")(
    lambda f: f.withColumn("r", S.byte_range(F.when(F.col("file_id") % 3 == 0, F.lit("bytes=-100")).when(F.col("file_id") % 3 == 1, F.concat(F.lit("bytes="), F.col("file_id").cast("string"), F.lit("-"), (F.col("file_id") + 50).cast("string"))).otherwise(F.concat(F.lit("bytes="), F.col("file_id").cast("string"), F.lit("-"))), F.col("size_bytes"))).select("file_id", "r.start", "r.stop"))
query("DML5_tag_state", "SELECT user_id, event_type AS tag, arg_max(value >= 50, {'ts': ts, 'e': event_id}) AS tagged FROM events GROUP BY user_id, event_type", "@events")(lambda e: e.groupBy("user_id", F.col("event_type").alias("tag")).agg(F.max_by(F.col("value") >= 50, F.struct("ts", "event_id")).alias("tagged")))

# ---- 2.2 filters and projections
_REASON = "CASE WHEN is_image AND size_bytes < 400 THEN 'images off' WHEN folder = '/lib/src3' OR starts_with(folder, '/lib/src3/') THEN 'excluded folder' WHEN NOT (starts_with(folder, '/lib/src')) THEN 'not included' WHEN (flags & 1) > 0 THEN 'manual' WHEN (flags & 2) > 0 THEN 'too dark' WHEN size_bytes NOT BETWEEN 200 AND 20000 THEN 'size' WHEN path LIKE '%9%.txt' THEN 'name' END"
query("FLT1_eligibility", f"SELECT file_id, {_REASON} AS reason FROM files", "files")(lambda f: f.select("file_id", S.rejection().alias("reason")))
query("FLT2_excluded_tally", f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM files) t WHERE reason IS NOT NULL GROUP BY reason", "files")(lambda f: f.select(S.rejection().alias("reason")).where("reason is not null").groupBy("reason").agg(one().alias("n")))
query("FLT2_WIN14_excluded_examples", f"SELECT reason, file_id FROM (SELECT reason, file_id, row_number() OVER (PARTITION BY reason ORDER BY file_id) AS rn FROM (SELECT file_id, {_REASON} AS reason FROM files) t WHERE reason IS NOT NULL) u WHERE rn <= 5", "files")(
    lambda f: f.select("file_id", S.rejection().alias("reason")).where("reason is not null").withColumn("rn", F.row_number().over(Window.partitionBy("reason").orderBy("file_id"))).where("rn <= 5").select("reason", "file_id"))
query("FLT3_folder_prefix", "SELECT file_id FROM files WHERE folder = '/lib/src1' OR starts_with(folder, '/lib/src1/')", "files")(lambda f: f.where(S.within_folder(F.col("folder"), "/lib/src1")).select("file_id"))
query("FLT4_glob_blacklist", "SELECT file_id FROM files WHERE NOT regexp_matches(path, '(^|/)(d[34]|[^/]*7\\.mp4)(/|$)')", "files")(lambda f: f.where(~(S.glob_hit(F.col("path"), "d3") | S.glob_hit(F.col("path"), "d4") | S.glob_hit(F.col("path"), "*7.mp4"))).select("file_id"))
query("FLT5_FLT7_glob_contains", "SELECT file_id FROM files WHERE (path LIKE '%src1%.mp4%' OR path LIKE '%d5%') AND NOT path LIKE '%99%'", "files")(lambda f: f.where((S.glob_like(F.col("path"), "src1*.mp4") | S.glob_like(F.col("path"), "d5")) & ~S.glob_like(F.col("path"), "99")).select("file_id"))
query("FLT6_substring", "SELECT file_id FROM files WHERE contains(path, '/d2/')", "files")(lambda f: f.where(F.contains("path", F.lit("/d2/"))).select("file_id"))
query("FLT8_size_range", "SELECT file_id FROM files WHERE size_bytes BETWEEN 1000 AND 5000", "files")(lambda f: f.where(F.col("size_bytes").between(1000, 5000)).select("file_id"))
query("FLT9_compare_eligible", "SELECT file_id FROM files WHERE (flags & 12) = 0 AND duration > 0", "files")(lambda f: f.where((F.col("flags").bitwiseAND(12) == 0) & (F.col("duration") > 0)).select("file_id"))
query("FLT10_same_folder_at_depth", "SELECT p.file_a, p.file_b FROM pairs p JOIN files a ON a.file_id = p.file_a JOIN files b ON b.file_id = p.file_b WHERE lower(split_part(a.folder, '/', -2)) = lower(split_part(b.folder, '/', -2))", "pairs", "files")(
    lambda p, f: p.join((f := f.withColumn("parent", F.regexp_replace("folder", "/[^/]*$", ""))).select(F.col("file_id").alias("file_a"), S.tail_folders("parent", 1).alias("fa")), "file_a").join(f.select(F.col("file_id").alias("file_b"), S.tail_folders("parent", 1).alias("fb")), "file_b").where("fa = fb").select("file_a", "file_b"))
query("FLT11_not_hardlinks", "SELECT p.file_a, p.file_b FROM pairs p JOIN files a ON a.file_id = p.file_a JOIN files b ON b.file_id = p.file_b WHERE NOT (a.ino = b.ino AND a.dev = b.dev)", "pairs", "files")(
    lambda p, f: p.join(f.select(F.col("file_id").alias("file_a"), F.col("ino").alias("ia"), F.col("dev").alias("da")), "file_a").join(f.select(F.col("file_id").alias("file_b"), F.col("ino").alias("ib"), F.col("dev").alias("db")), "file_b").where("not (ia = ib and da = db)").select("file_a", "file_b"))
query("FLT12_result_filter", "SELECT group_id, item_id FROM (SELECT *, bool_or(path LIKE '%widget%' AND NOT is_image AND sim BETWEEN 950 AND 1000) OVER (PARTITION BY group_id) AS hit FROM members) t WHERE hit", "members")(
    lambda m: m.withColumn("hit", F.max((F.contains("path", F.lit("widget")) & ~F.col("is_image") & F.col("sim").between(950, 1000)).cast("int")).over(Window.partitionBy("group_id"))).where("hit = 1").select("group_id", "item_id"))
query("FLT13_JN19_groups_with_path", "SELECT DISTINCT group_id FROM members WHERE path LIKE '%ring%'", "members")(lambda m: m.select("group_id").distinct().join(m.where(F.contains("path", F.lit("ring"))), "group_id", "left_semi"))
query("FLT14_group_having", "SELECT group_id, max(sim) AS top FROM members GROUP BY group_id HAVING max(sim) >= 990 AND bool_or(is_image)", "members")(lambda m: m.groupBy("group_id").agg(F.max("sim").alias("top"), F.bool_or("is_image").alias("i")).where("top >= 990 and i").select("group_id", "top"))
query("FLT15_pair_filter", "SELECT file_a, file_b FROM pairs WHERE sim >= 900 AND lower(method) LIKE '%audio%'", "pairs")(lambda p: p.where((F.col("sim") >= 900) & F.lower("method").contains("audio")).select("file_a", "file_b"))
query("FLT16_text_filter", "SELECT file_id FROM files WHERE contains(lower(path), '.jpg')", "files")(lambda f: f.where(F.lower("path").contains(".jpg")).select("file_id"))
query("FLT17_missing_fingerprints", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.toxic = 1", "@documents", "@labels")(lambda d, l: d.join(l, "doc_id", "left").where("quality is null or toxic = 1").select("doc_id"))
query("FLT18_UDF1_UDF4_user_predicate", "SELECT file_id FROM files WHERE size_bytes > 500 AND path LIKE '%.mkv' AND (flags & 4) = 0", "files")(lambda f: S.user_filter(f, "size_bytes > 500 and path like '%.mkv' and (flags & 4) = 0").select("file_id"))
query("FLT19_user_group_policy", "SELECT group_id FROM members GROUP BY group_id HAVING count_if(size_bytes >= 1) = count(*)", "members")(lambda m: m.groupBy("group_id").agg(F.count_if(F.expr("size_bytes >= 1")).alias("k"), one().alias("n")).where("k = n").select("group_id"))
query("FLT20_custom_selection", "SELECT group_id, item_id FROM (SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY created, item_id) AS rn FROM members WHERE NOT is_image AND size_bytes BETWEEN 3 AND 40 AND sim >= 910) t WHERE rn > 1", "members")(
    lambda m: R.ranked(m.where("not is_image and size_bytes between 3 and 40 and sim >= 910"), [F.col("created"), F.col("item_id")]).where("rn > 1").select("group_id", "item_id"))
query("FLT21_identity", "SELECT group_id, size_bytes, duration, count(*) AS n FROM members GROUP BY ALL HAVING count(*) > 1", "members")(lambda m: m.groupBy("group_id", "size_bytes", "duration").agg(one().alias("n")).where("n > 1"))
query("PRJ1_best_stream", "SELECT o_custkey, arg_max(o_orderkey, (CAST(floor(o_totalprice / 10000) AS BIGINT), -o_orderkey)) AS stream FROM orders GROUP BY o_custkey", "@orders")(
    lambda o: o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.floor(F.col("o_totalprice") / 10000), -F.col("o_orderkey"))).alias("stream")))
query("PRJ2_derived", "SELECT file_id, width + height AS frame_size, CAST(len(string_split(folder, '/')) - 1 AS INT) AS depth, CASE WHEN flags >= 12 THEN 4 WHEN flags >= 8 THEN 3 WHEN flags >= 4 THEN 2 WHEN flags >= 2 THEN 1 ELSE 0 END AS hdr_rank FROM files", "files")(
    lambda f: f.select("file_id", (F.col("width") + F.col("height")).alias("frame_size"), (F.size(F.split("folder", "/")) - 1).alias("depth"), F.when(F.col("flags") >= 12, 4).when(F.col("flags") >= 8, 3).when(F.col("flags") >= 4, 2).when(F.col("flags") >= 2, 1).otherwise(0).alias("hdr_rank")))
query("PRJ3_hdr_format", "SELECT file_id, CASE WHEN codec = 'de' AND (flags & 1) = 1 THEN 'Dolby Vision' WHEN codec = 'fr' THEN 'HDR10' WHEN codec = 'es' THEN 'HLG' ELSE 'SDR' END AS hdr FROM files", "files")(
    lambda f: f.select("file_id", F.when((F.col("codec") == "de") & (F.col("flags").bitwiseAND(1) == 1), "Dolby Vision").when(F.col("codec") == "fr", "HDR10").when(F.col("codec") == "es", "HLG").otherwise("SDR").alias("hdr")))
query("PRJ4_accessors", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "@documents", "@labels")(lambda d, l: d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
_SERIES = "SELECT user_id, list(block ORDER BY pos) AS b, list(value ORDER BY pos) AS v FROM points GROUP BY user_id"
series = lambda p: p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block", "value"))).alias("r")).select("user_id", F.col("r.block").alias("b"), F.col("r.value").alias("v"))
query("PRJ5_usable_samples", "SELECT user_id, CAST(list_sum(list_filter(b, lambda x: x <> 0)) AS BIGINT) AS total, CAST(len(list_filter(b, lambda x: x <> 0)) AS INT) AS n FROM (" + _SERIES + ") t", "points")(
    lambda p: series(p).select("user_id", F.aggregate(F.filter("b", lambda x: x != 0), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(F.filter("b", lambda x: x != 0)).alias("n")))

# ---- 2.3 joins
_WORD_HASH = "SELECT doc_id, " + " + ".join(f"(CASE WHEN sum((h >> {i}) & 1) >= count(*) // 2 + 1 THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(60)) + " AS hash FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) t) u GROUP BY doc_id"


def word_hashes(d: DataFrame) -> DataFrame:
    """(id, hash): the majority vote over 60-bit hashes of a text's words."""
    return K.text_votes(d, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("vote").alias("hash"))


query("AGG13_majority_vote", _WORD_HASH.replace("SELECT doc_id, ", "SELECT doc_id AS id, ", 1), "@documents")(word_hashes)
query("JN1_SIM4_similarity_join", f"WITH h AS ({_WORD_HASH}) SELECT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INT) AS hamming, round(1 - bit_count(xor(x.hash, y.hash)) / 60.0, 6) AS similarity FROM h x JOIN h y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.hash, y.hash)) <= 2", "@documents")(
    lambda d: J.hamming_join(word_hashes(d), 60, 2).withColumn("similarity", F.round(1 - F.col("hamming") / 60.0, 6)))
query("JN2_JN3_JN4_duration_band_join", "SELECT a.file_id AS a, b.file_id AS b FROM files a JOIN files b ON a.file_id < b.file_id AND a.codec = b.codec AND a.is_image = b.is_image WHERE NOT a.is_image AND abs(a.duration - b.duration) * 100 <= least(a.duration, b.duration) * 2 AND a.duration > 0 AND b.duration > 0", "files")(
    lambda f: J.band_join(f.where("not is_image"), "file_id", "duration", 2, ["codec", "is_image"]))
query("JN4_tolerance", "SELECT file_id, CAST(least(greatest(duration * 0.01, 5.0), 10.0) AS DOUBLE) AS tol FROM files", "files")(lambda f: f.select("file_id", J.tolerance(F.col("duration").cast("double"), 1, 5.0, 10.0).alias("tol")))
query("JN5_JN6_containment_join", "SELECT c.file_id AS clip, s.file_id AS source FROM files c JOIN files s ON c.duration < s.duration WHERE c.duration >= 1 AND s.duration >= 1 AND c.duration * 10 >= s.duration AND c.duration * 100 < s.duration * 95", "files")(lambda f: J.containment_join(f, "file_id", "duration", (1, 10), (95, 100)))
_TL = "SELECT user_id, list(block ORDER BY pos) AS b FROM points GROUP BY user_id"
timelines = lambda p, user, b: series(p).select(F.col("user_id").alias(user), F.col("b").alias(b))


def neighbours(p: DataFrame) -> DataFrame:
    """(clip, s, source, l) of the series of users that follow one another, the shorter as the clip."""
    both = timelines(p, "u", "x").join(timelines(p, "v", "y"), F.col("u") + 1 == F.col("v"))
    swap = F.struct(F.size("x"), "u") < F.struct(F.size("y"), "v")
    one_, two = F.struct(F.col("u").alias("id"), F.col("x").alias("b")), F.struct(F.col("v").alias("id"), F.col("y").alias("b"))
    return both.select(F.when(swap, one_).otherwise(two).alias("c"), F.when(swap, two).otherwise(one_).alias("d")).select(F.col("c.id").alias("clip"), F.col("c.b").alias("s"), F.col("d.id").alias("source"), F.col("d.b").alias("l"))


query("ARR1_JN6_audio_window", f"SELECT clip, source, CAST((best // 100000) AS INT) AS bits, CAST(best % 100000 AS INT) AS pos FROM (SELECT s.user_id AS clip, l.user_id AS source, len(s.b) AS n, list_min(list_transform(range(0, len(l.b) - len(s.b) + 1), lambda o: CAST(list_sum(list_transform(range(1, len(s.b) + 1), lambda k: bit_count(xor(s.b[k], l.b[o + k])))) AS BIGINT) * 100000 + o)) AS best FROM ({_TL}) s JOIN ({_TL}) l ON len(s.b) < len(l.b) OR (len(s.b) = len(l.b) AND s.user_id < l.user_id)) t WHERE (best // 100000) * 100 <= n * 32 * 30", "points")(
    lambda p: X.all_pairs(timelines(p, "id", "b"), X.hamming_window(70), ["bits", "pos"]))
# Hits of an alignment as a string of ones and zeros: runs end at two misses in a row; what follows the miss above the budget is cut off.
_ALIGNED = f"SELECT s.user_id AS clip, l.user_id AS source, len(s.b) AS n, o, array_to_string(list_transform(range(1, len(s.b) + 1), lambda k: CASE WHEN bit_count(xor(s.b[k], l.b[o + k])) <= 9 THEN '1' ELSE '0' END), '') AS h FROM ({_TL}) s JOIN ({_TL}) l ON {{}}, unnest(range(0, len(l.b) - len(s.b) + 1)) AS t(o)"
_SHORTER = "(len(s.b) < len(l.b) OR (len(s.b) = len(l.b) AND s.user_id < l.user_id))"
query("ARR2_JN7_timeline_join", f"SELECT clip, source, CAST(match AS INT) AS match, CAST(run AS INT) AS run, CAST(o AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY clip, source ORDER BY match DESC, run DESC, o) AS rn FROM (SELECT clip, source, n, o, len(replace(c, '0', '')) AS match, list_max(list_transform(string_split(c, '00'), lambda x: len(rtrim(x, '0')))) AS run FROM (SELECT *, array_to_string(string_split(h, '0')[1:CAST(ceil(n * 0.300000011920929) AS INT) + 1], '0') AS c FROM ({_ALIGNED.format(_SHORTER)}) x WHERE n >= 2) y) z) w WHERE rn = 1 AND match * 12 >= n * 6", "points")(
    lambda p: X.all_pairs(timelines(p, "id", "b").where("size(b) >= 2"), X.tolerant_runs(K.hamming_budget(0.85), 1, (6, 12)), ["match", "run", "pos"]))
query("ARR3_place_matches", f"SELECT clip, source, CAST(match AS INT) AS match, CAST(run AS INT) AS run, CAST(o AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY clip, source ORDER BY match DESC, o) AS rn FROM (SELECT clip, source, o, len(replace(h, '0', '')) AS match, list_max(list_transform(string_split(h, '00'), lambda x: len(replace(x, '0', '')))) AS run FROM ({_ALIGNED.format('abs(s.user_id - l.user_id) = 1 AND ' + _SHORTER)}) x) z) w WHERE rn = 1", "points")(
    lambda p: neighbours(p).withColumn("r", K.sliding_matches("s", "l", K.hamming_budget(0.85), 1)).where("r is not null").select("clip", "source", "r.match", "r.run", F.col("r.offset").alias("pos")))


query("JN8_average_hash_filter", f"WITH h AS ({_WORD_HASH}) SELECT p.file_a, p.file_b FROM pairs p JOIN h x ON x.doc_id = p.file_a JOIN h y ON y.doc_id = p.file_b WHERE bit_count(xor(x.hash, y.hash)) <= 25", "pairs", "@documents")(
    lambda p, d: p.join(word_hashes(d).select(F.col("id").alias("file_a"), F.col("hash").alias("x")), "file_a").join(word_hashes(d).select(F.col("id").alias("file_b"), F.col("hash").alias("y")), "file_b").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 25).select("file_a", "file_b"))
query("JN9_length_ratio_join", "SELECT a.file_id AS a, b.file_id AS b FROM files a JOIN files b ON a.file_id < b.file_id WHERE a.duration > 0 AND b.duration > 0 AND (greatest(a.duration, b.duration) - least(a.duration, b.duration)) * 100 <= greatest(a.duration, b.duration) * 20", "files")(
    lambda f: J.ratio_join(f, "file_id", "duration", 20))
query("JN10_STR4_rescan_one", f"WITH h AS ({_WORD_HASH}) SELECT x.doc_id AS target, y.doc_id AS other, CASE WHEN bit_count(xor(x.hash, y.hash)) <= 2 THEN 'hash' ELSE 'size' END AS method FROM h x JOIN documents dx ON dx.doc_id = x.doc_id JOIN h y ON y.doc_id <> x.doc_id JOIN documents dy ON dy.doc_id = y.doc_id WHERE x.doc_id = 1 AND (bit_count(xor(x.hash, y.hash)) <= 2 OR dx.n_chars = dy.n_chars)", "@documents")(
    lambda d: _rescan(d, 1))


def _rescan(d: DataFrame, target: int) -> DataFrame:
    h = word_hashes(d).join(d.select(F.col("doc_id").alias("id"), "n_chars"), "id")
    t = F.broadcast(h.where(F.col("id") == target).limit(1).select(F.col("id").alias("target"), F.col("hash").alias("th"), F.col("n_chars").alias("tn")))
    near = F.bit_count(F.col("hash").bitwiseXOR(F.col("th"))) <= 2
    return h.join(t, F.col("id") != F.col("target")).where(near | (F.col("n_chars") == F.col("tn"))).select("target", F.col("id").alias("other"), F.when(near, "hash").otherwise("size").alias("method"))


query("JN11_DML1_STR3_upsert", "SELECT coalesce(o.file_id, n.file_id) AS file_id, CASE WHEN o.file_id IS NULL THEN n.size_bytes WHEN n.file_id IS NULL OR o.size_bytes = n.size_bytes THEN o.size_bytes ELSE n.size_bytes END AS size_bytes, CASE WHEN o.file_id IS NULL THEN 'insert' WHEN n.file_id IS NULL OR o.size_bytes = n.size_bytes THEN 'keep' ELSE 'replace' END AS action FROM files o FULL JOIN (SELECT file_id + 10 AS file_id, size_bytes FROM files) n ON n.file_id = o.file_id", "files")(
    lambda f: J.upsert(f.select("file_id", "size_bytes"), f.select((F.col("file_id") + 10).alias("file_id"), "size_bytes"), "file_id", ["size_bytes"]))
query("JN12_ungrouped", "SELECT file_id FROM files WHERE file_id NOT IN (SELECT file_a FROM pairs WHERE sim >= 800 UNION SELECT file_b FROM pairs WHERE sim >= 800)", "files", "pairs")(lambda f, p: f.join(p.where("sim >= 800").select(F.col("file_a").alias("file_id")).union(p.where("sim >= 800").select("file_b")), "file_id", "left_anti").select("file_id"))
query("JN13_SET5_blacklisted_groups", "SELECT DISTINCT g AS group_id FROM (SELECT g, entry_id, count(*) AS k FROM (SELECT DISTINCT m.file_id % 300 AS g, m.folder AS path FROM files m) m JOIN (SELECT DISTINCT entry_id, path FROM blacklist) b USING (path) GROUP BY g, entry_id) h JOIN (SELECT file_id % 300 AS g, count(DISTINCT folder) AS n FROM files GROUP BY 1) s USING (g) WHERE h.k = s.n", "files", "blacklist")(
    lambda f, b: J.covered_groups(f.select((F.col("file_id") % 300).alias("group_id"), F.col("folder").alias("path")), b))
query("JN14_DML4_pair_blacklist", "SELECT file_a, file_b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.file_a % 4 = 0 AND q.file_a = p.file_a AND q.file_b = p.file_b)", "pairs")(
    lambda p: J.undirected_anti(p, p.where("file_a % 4 = 0").select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b")), "file_a", "file_b").select("file_a", "file_b"))
query("JN15_id_lookup", "SELECT p.file_a, p.file_b, f.path FROM pairs p JOIN files f ON f.file_id = p.file_a + 60", "pairs", "files")(lambda p, f: p.join(f, F.col("file_a") + 60 == F.col("file_id")).select("file_a", "file_b", "path"))
query("JN16_folder_hop", "SELECT file_id, path FROM files WHERE folder = '/lib/src2/d1'", "files")(lambda f: f.where(F.col("folder") == "/lib/src2/d1").select("file_id", "path"))
query("JN17_incident_edges", "SELECT file_a, file_b, sim FROM pairs WHERE file_a = 40 OR file_b = 40", "pairs")(lambda p: p.where("file_a = 40 or file_b = 40").select("file_a", "file_b", "sim"))
query("JN18_relocation", "SELECT m.file_id, count(f.file_id) AS n, CASE count(f.file_id) WHEN 0 THEN 'NotFound' WHEN 1 THEN 'Unique' ELSE 'Ambiguous' END AS confidence FROM (SELECT * FROM files WHERE file_id % 4 = 0) m LEFT JOIN (SELECT * FROM files WHERE file_id % 4 <> 0) f ON f.size_bytes = m.size_bytes AND abs(f.mtime - m.mtime) <= 200000 GROUP BY m.file_id", "files")(
    lambda f: f.where("file_id % 4 = 0").alias("m").join(f.where("file_id % 4 <> 0").alias("f"), (F.col("m.size_bytes") == F.col("f.size_bytes")) & (F.abs(F.col("f.mtime") - F.col("m.mtime")) <= 200000), "left").groupBy(F.col("m.file_id").alias("file_id")).agg(F.count("f.file_id").alias("n")).withColumn("confidence", F.when(F.col("n") == 0, "NotFound").when(F.col("n") == 1, "Unique").otherwise("Ambiguous")))
query("JN20_keeper_lookup", "SELECT m.item_id, k.keeper FROM members m JOIN (SELECT group_id, min(item_id) AS keeper FROM members WHERE NOT checked GROUP BY group_id) k USING (group_id) WHERE m.checked", "members")(
    lambda m: m.where("checked").join(m.where("not checked").groupBy("group_id").agg(F.min("item_id").alias("keeper")), "group_id").select("item_id", "keeper"))

# ---- 2.4 similarity predicates
_PIX = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT) % 128 + 128) AS f FROM embeddings"
pixels = lambda e: e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100) % 128 + 128).alias("f"))
frames = lambda e: pixels(e).alias("x").join(pixels(e).alias("y"), F.col("x.vec_id") + 1 == F.col("y.vec_id"))
_PIX = _PIX.replace("floor(x * 100)", "floor(CAST(x AS DOUBLE) * 100)")
query("SIM1_frame_difference", f"SELECT x.vec_id AS a, round(list_sum(list_transform(range(1, 65), lambda i: abs(x.f[i] - y.f[i]))) / 64.0 / 256, 9) AS diff FROM ({_PIX}) x JOIN ({_PIX}) y ON y.vec_id = x.vec_id + 1", "@embeddings")(lambda e: frames(e).select(F.col("x.vec_id").alias("a"), F.round(K.frame_difference("x.f", "y.f"), 9).alias("diff")))
query("SIM2_masked_difference", f"SELECT a, CASE WHEN len(d) = 0 THEN -1 ELSE round(list_sum(d) / CAST(len(d) AS DOUBLE) / 256, 9) END AS diff FROM (SELECT x.vec_id AS a, list_transform(list_filter(range(1, 65), lambda i: x.f[i] > 100 AND y.f[i] > 100 AND x.f[i] < 160 AND y.f[i] < 160), lambda i: abs(x.f[i] - y.f[i])) AS d FROM ({_PIX}) x JOIN ({_PIX}) y ON y.vec_id = x.vec_id + 1) t", "@embeddings")(
    lambda e: frames(e).select(F.col("x.vec_id").alias("a"), K.frame_difference_within("x.f", "y.f", 100, 160).alias("d")).select("a", F.when(F.isnan("d"), -1.0).otherwise(F.round("d", 9)).alias("diff")))
query("SIM3_decision", f"SELECT x.vec_id AS a, list_sum(list_transform(range(1, 65), lambda i: abs(x.f[i] - y.f[i]))) * 100 <= 64 * 256 * 4 AS dup FROM ({_PIX}) x JOIN ({_PIX}) y ON y.vec_id = x.vec_id + 1", "@embeddings")(lambda e: frames(e).select(F.col("x.vec_id").alias("a"), (K.frame_difference("x.f", "y.f") * 100 <= 4).alias("dup")))
_SIGN = "SELECT vec_id, list_sum(list_transform(range(1, 61), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT AS h FROM embeddings"
signs = lambda e: e.select(F.col("vec_id").alias("id"), F.aggregate(F.transform(F.slice("embedding", 1, 60), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x).alias("hash"))
query("SCL15_ORD10_hamming_knn", f"SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS INT) AS dist FROM ({_SIGN}) x JOIN ({_SIGN}) y ON x.vec_id = 7 AND y.vec_id <> 7 ORDER BY dist, b LIMIT 50", "@embeddings")(
    lambda e: signs(e).where("id <> 7").join(F.broadcast(signs(e).where("id = 7").limit(1).select(F.col("id").alias("a"), F.col("hash").alias("ha"))), F.lit(True)).select("a", F.col("id").alias("b"), F.bit_count(F.col("hash").bitwiseXOR(F.col("ha"))).cast("int").alias("dist")).orderBy("dist", "b").limit(50))
query("SIM5_flipped", f"SELECT x.vec_id AS a, list_sum(list_transform(range(1, 65), lambda i: abs(x.f[i] - y.f[i]))) AS d, list_sum(list_transform(range(1, 65), lambda i: abs(x.f[i] - y.f[((i - 1) // 8) * 8 + 8 - (i - 1) % 8]))) AS dflip FROM ({_PIX}) x JOIN ({_PIX}) y ON y.vec_id = x.vec_id + 1".replace("AS d,", "::BIGINT AS d,").replace("AS dflip", "::BIGINT AS dflip"), "@embeddings")(
    lambda e: frames(e).select(F.col("x.vec_id").alias("a"), F.col("x.f").alias("p"), F.col("y.f").alias("q")).withColumn("r", K.flip("q", 8)).select("a", L(F.round(K.frame_difference("p", "q") * 64 * 256)).alias("d"), L(F.round(K.frame_difference("p", "r") * 64 * 256)).alias("dflip")))
query("SIM10_SIM6_prefix_similarity", f"SELECT a, b, round(1 - list_sum(list_transform(range(1, n + 1), lambda k: bit_count(xor(sb[k], lb[k])))) / (n * 32.0), 9) AS sim FROM (SELECT s.user_id AS a, l.user_id AS b, s.b AS sb, l.b AS lb, least(len(s.b), len(l.b)) AS n FROM ({_TL}) s JOIN ({_TL}) l ON s.user_id < l.user_id) t", "points")(
    lambda p: X.all_pairs(timelines(p, "id", "b"), X.prefix_bits(), ["bits", "n"]).select(F.least("clip", "source").alias("a"), F.greatest("clip", "source").alias("b"), X.alike(F.col("bits"), F.col("n")).alias("sim")))
query("SIM9_match_offset", "SELECT user_id, event_id, try_cast(nullif(regexp_extract(concat('x match at offset ', CAST(value AS STRING), ' y'), 'match at offset ([-0-9.]+)', 1), '') AS DOUBLE) AS off FROM events", "@events")(
    lambda e: e.select("user_id", "event_id", F.regexp_extract(F.concat(F.lit("x match at offset "), F.col("value").cast("string"), F.lit(" y")), "match at offset ([-0-9.]+)", 1).cast("double").alias("off")))

# ---- 2.5 aggregations
query("AGG1_AGG6_group_stats", "SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS items, round(avg(n), 6) AS mean, max(n) AS most, count_if(n > 5)::BIGINT AS over5, count_if(n > 80)::BIGINT AS over80, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT group_id, count(*) AS n, sum(size_bytes) AS bytes FROM members GROUP BY group_id) t", "members")(
    lambda m: m.groupBy("group_id").agg(one().alias("n"), F.sum("size_bytes").alias("bytes")).agg(one().alias("n_groups"), F.sum("n").alias("items"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") > 5).alias("over5"), F.count_if(F.col("n") > 80).alias("over80"), F.sum("bytes").alias("bytes")))
query("AGG2_library_stats", "SELECT count(*) AS n_pairs, CAST(sum(CASE WHEN a.size_bytes > 0 AND b.size_bytes > 0 THEN least(a.size_bytes, b.size_bytes) ELSE 0 END) AS BIGINT) AS waste FROM pairs p JOIN files a ON a.file_id = p.file_a JOIN files b ON b.file_id = p.file_b", "pairs", "files")(
    lambda p, f: p.join(f.select(F.col("file_id").alias("file_a"), F.col("size_bytes").alias("sa")), "file_a").join(f.select(F.col("file_id").alias("file_b"), F.col("size_bytes").alias("sb")), "file_b").agg(one().alias("n_pairs"), F.sum(F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.least("sa", "sb")).otherwise(0)).alias("waste")))
query("AGG3_by_method", "SELECT method, count(*) AS n FROM pairs GROUP BY method ORDER BY n DESC, method", "pairs")(lambda p: p.groupBy("method").agg(one().alias("n")).orderBy(F.desc("n"), "method"))
query("AGG4_AGG17_cluster_stats", "SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS files, CAST(sum(total - most) AS BIGINT) AS reclaimable, round(avg(top), 6) AS mean_top FROM (SELECT group_id, count(*) AS n, sum(size_bytes) AS total, max(size_bytes) AS most, max(sim) AS top FROM members GROUP BY group_id) t", "members")(
    lambda m: m.groupBy("group_id").agg(one().alias("n"), F.sum("size_bytes").alias("total"), F.max("size_bytes").alias("most"), F.max("sim").alias("top")).agg(one().alias("n_groups"), F.sum("n").alias("files"), F.sum(F.col("total") - F.col("most")).alias("reclaimable"), F.round(F.avg("top"), 6).alias("mean_top")))
query("AGG5_method_breakdown", "SELECT p.method, count(*) AS n_pairs, CAST(sum(f.size_bytes) AS BIGINT) AS bytes FROM pairs p JOIN files f ON f.file_id = p.file_a GROUP BY p.method", "pairs", "files")(lambda p, f: p.join(f, F.col("file_a") == F.col("file_id")).groupBy("method").agg(one().alias("n_pairs"), F.sum("size_bytes").alias("bytes")))
query("AGG7_count", "SELECT count(*) AS n FROM files", "files")(lambda f: f.agg(one().alias("n")))
query("AGG8_dry_run", "SELECT group_id, CAST(coalesce(sum(size_bytes) FILTER (WHERE checked), 0) AS BIGINT) AS saved, CAST(array_to_string(list(item_id ORDER BY item_id) FILTER (WHERE checked), ',') AS STRING) AS remove FROM members GROUP BY group_id", "members")(
    lambda m: m.groupBy("group_id").agg(F.coalesce(F.sum(F.when(F.col("checked"), F.col("size_bytes"))), F.lit(0)).alias("saved"), F.array_sort(F.collect_list(F.when(F.col("checked"), F.col("item_id")))).alias("r")).select("group_id", "saved", F.when(F.size("r") > 0, F.array_join("r", ",")).alias("remove")))
query("AGG9_fingerprint_summary", "SELECT user_id, count_if(block <> 0)::BIGINT AS used, round(avg(value), 6) AS mean, arg_min(pos, (value, pos)) AS darkest FROM points GROUP BY user_id", "points")(lambda p: p.groupBy("user_id").agg(F.count_if(F.col("block") != 0).alias("used"), F.round(F.avg("value"), 6).alias("mean"), L(F.min_by("pos", F.struct("value", "pos"))).alias("darkest")))
query("AGG10_WIN11_gap_stats", "SELECT user_id, max(g) AS most, min(g) AS least, count(g) AS n FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM points) t GROUP BY user_id", "points")(lambda p: p.withColumn("g", F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("pos"))).groupBy("user_id").agg(F.max("g").alias("most"), F.min("g").alias("least"), F.count("g").alias("n")))
query("AGG11_silence", "SELECT user_id, round(count_if(block = 0) / CAST(count(*) AS DOUBLE), 9) AS ratio, count_if(block = 0) * 2 < count(*) AND count(*) >= 10 AS reliable FROM points GROUP BY user_id", "points")(lambda p: p.groupBy("user_id").agg(F.count_if(F.col("block") == 0).alias("z"), one().alias("n")).select("user_id", F.round(F.col("z") / F.col("n"), 9).alias("ratio"), ((F.col("z") * 2 < F.col("n")) & (F.col("n") >= 10)).alias("reliable")))
query("AGG12_too_dark", f"SELECT vec_id, len(list_filter(f, lambda v: v <= 130)) * 100 >= len(f) * 60 AS dark FROM ({_PIX}) t", "@embeddings")(lambda e: pixels(e).select("vec_id", (F.size(F.filter("f", lambda v: v <= 130)) * 100 >= F.size("f") * 60).alias("dark")))
query("AGG14_silent", "SELECT user_id, bool_and(block IN (0, 65535)) AS silent FROM points GROUP BY user_id", "points")(lambda p: p.groupBy("user_id").agg(F.bool_and(F.col("block").isin(0, 65535)).alias("silent")))
query("AGG15_coverage", "SELECT group_id, count_if(is_image)::BIGINT AS clips, round(coalesce(sum(duration) FILTER (WHERE is_image), 0) / CAST(nullif(max(duration), 0) AS DOUBLE), 6) AS coverage FROM members GROUP BY group_id", "members")(lambda m: m.groupBy("group_id").agg(F.count_if("is_image").alias("clips"), F.round(F.coalesce(F.sum(F.when(F.col("is_image"), F.col("duration"))), F.lit(0)) / F.nullif(F.max("duration"), F.lit(0)), 6).alias("coverage")))
query("AGG16_badges", "SELECT group_id, bit_or(flags) AS any_flags, bool_or((flags & 1) > 0) AS any_flipped, bool_and((flags & 2) > 0) AS all_partial FROM members GROUP BY group_id", "members")(lambda m: m.groupBy("group_id").agg(F.bit_or("flags").alias("any_flags"), F.bool_or(F.col("flags").bitwiseAND(1) > 0).alias("any_flipped"), F.bool_and(F.col("flags").bitwiseAND(2) > 0).alias("all_partial")))
query("AGG18_distinct_groups", "SELECT DISTINCT group_id FROM members", "members")(lambda m: m.select("group_id").distinct())
query("AGG19_change_count", "SELECT count_if(path LIKE '/lib/src1/%')::BIGINT AS changed FROM files", "files")(lambda f: f.agg(F.count_if(F.col("path").startswith("/lib/src1/")).alias("changed")))

# ---- 2.6 windows
_AX = [("duration", "max", True), ("frame_size", "max", False), ("bitrate", "max", True), ("fps", "max", True), ("audio_rate", "max", True), ("size_bytes", "min", False)]
_NAME = dict(duration="duration", frame_size="resolution", bitrate="bitrate", fps="fps", audio_rate="audio", size_bytes="size")
query("WIN1_best_flags", "SELECT group_id, item_id, " + ", ".join(f"CASE WHEN {'NOT is_image' if v else 'true'} THEN {c} = {f}({c}) OVER g END AS best_{_NAME[c]}" for c, f, v in _AX) + ", sim = max(sim) OVER g AS best_sim, created = min(created) OVER g AS best_created FROM members WINDOW g AS (PARTITION BY group_id)", "members")(
    lambda m: R.best_flags(m).select("group_id", "item_id", *[f"best_{n}" for n in ("duration", "resolution", "bitrate", "fps", "audio", "size", "sim", "created")]))
_ORD = lambda *cs: ", ".join((f"CASE WHEN NOT is_image THEN {c} END DESC NULLS LAST" if v else f"{c} DESC NULLS LAST") for c, v in cs) + ", item_id"
_Q = (("frame_size", False), ("duration", True), ("bitrate", True), ("fps", True), ("audio_rate", True))
_RN = "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {}) AS rn FROM members"
query("WIN2_WIN17_keeper", f"SELECT group_id, item_id FROM ({_RN.format(_ORD(*_Q))}) t WHERE rn = 1", "members")(lambda m: R.ranked(m, R.order(R.PRESETS["quality"], only=True)).where("rn = 1").select("group_id", "item_id"))
query("WIN3_WIN4_UDF2_criteria_order", f"SELECT group_id, item_id FROM ({_RN.format(_ORD(('size_bytes', False), ('fps', True), ('duration', True), ('frame_size', False), ('bitrate', True), ('audio_rate', True)))}) t WHERE rn = 1", "members")(lambda m: R.ranked(m, R.order(["size", "nonsense", "fps"])).where("rn = 1").select("group_id", "item_id"))
for _n, _s, _o in (("quality", "lowest_quality", _ORD(*_Q)), ("smallest", "smallest_file", "size_bytes DESC, item_id"), ("shortest", "shortest", "duration DESC, item_id"), ("resolution", "worst_resolution", "frame_size DESC, item_id")):
    query(f"WIN5_WIN6_delete_{_n}", f"SELECT group_id, item_id FROM ({_RN.format(_o)}) t WHERE rn > 1", "members")(lambda m, s=_s: R.deletions(m, s).select("group_id", "item_id"))
query("WIN5_delete_identical", "SELECT group_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size_bytes DESC, item_id) AS rn, min(s) OVER (PARTITION BY group_id) AS least FROM (SELECT *, CASE WHEN group_id LIKE '%1' THEN 1000 ELSE sim END AS s FROM members) x) t WHERE rn > 1 AND least >= 1000", "members")(
    lambda m: R.deletions(m.withColumn("sim", F.when(F.col("group_id").endswith("1"), F.lit(1000).cast("long")).otherwise(F.col("sim"))), "identical_only").select("group_id", "item_id"))
for _n, _c in (("oldest", "created DESC, item_id"), ("newest", "created, item_id"), ("smaller", "size_bytes DESC, item_id")):
    query(f"WIN7_WIN8_select_{_n}", f"SELECT group_id, item_id FROM ({_RN.format(_c)}) t WHERE rn > 1", "members")(lambda m, c=_c: R.ranked(m, [F.expr(x).desc() if d else F.expr(x).asc() for x, d in ((y.replace(" DESC", "").strip(), "DESC" in y) for y in c.split(","))]).where("rn > 1").select("group_id", "item_id"))
query("WIN8_invert", "SELECT item_id, NOT checked AS checked FROM members", "members")(lambda m: m.select("item_id", (~F.col("checked")).alias("checked")))
_CLIPS = "SELECT CASE WHEN a.duration >= b.duration THEN a.file_id ELSE b.file_id END AS source, greatest(a.duration, b.duration) AS secs, CASE WHEN a.duration >= b.duration THEN b.file_id ELSE a.file_id END AS clip FROM pairs p JOIN files a ON a.file_id = p.file_a JOIN files b ON b.file_id = p.file_b"
_BEST_CLIP = f"SELECT clip, source FROM (SELECT clip, source, row_number() OVER (PARTITION BY clip ORDER BY secs DESC, source) AS rn FROM ({_CLIPS}) t) u WHERE rn = 1"
query("WIN9_clip_assignment", _BEST_CLIP, "pairs", "files")(lambda p, f: G.clip_groups(_clips(p, f))[0].select("clip", "source"))
query("WIN9_clip_groups", f"SELECT source AS group_id, clip AS member FROM ({_BEST_CLIP}) x UNION SELECT source, source FROM ({_BEST_CLIP}) y", "pairs", "files")(lambda p, f: G.clip_groups(_clips(p, f))[1])
query("WIN10_fir", "SELECT user_id, pos, round(y, 6) AS y FROM (SELECT user_id, pos, (value * 0.25 + lag(value, 1) OVER w * 0.5 + lag(value, 2) OVER w + lag(value, 3) OVER w * 0.5 + lag(value, 4) OVER w * 0.25) / 2.5 AS y FROM points WINDOW w AS (PARTITION BY user_id ORDER BY pos)) t WHERE y IS NOT NULL", "points")(lambda p: K.fir(p, "user_id", "pos", "value").select("user_id", L("pos").alias("pos"), F.round("y", 6).alias("y")))
query("WIN12_thin_samples", "SELECT user_id, CAST(len(list_reduce(list_transform(list_sort(v), lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] >= 5 THEN list_concat(a, b) ELSE a END)) AS INT) AS kept FROM (" + _SERIES + ") t", "points")(lambda p: series(p).withColumn("t", F.array_sort("v")).select("user_id", F.size(K.thin_samples("t", 5.0)).alias("kept")))
query("WIN13_difference_to_best", "SELECT item_id, CASE WHEN m = 0 THEN NULL ELSE round((size_bytes - m) * 100.0 / m, 6) END AS pct FROM (SELECT item_id, size_bytes, max(size_bytes) OVER (PARTITION BY group_id) AS m FROM members) t", "members")(lambda m: m.withColumn("m", F.max("size_bytes").over(Window.partitionBy("group_id"))).select("item_id", F.when(F.col("m") != 0, F.round((F.col("size_bytes") - F.col("m")) * 100.0 / F.col("m"), 6)).alias("pct")))
query("WIN15_last_500", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500", "@events")(lambda e: e.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id"))
query("WIN16_next_group", "SELECT g AS group_id, coalesce(lead(g) OVER (ORDER BY g), min(g) OVER ()) AS next FROM (SELECT DISTINCT group_id AS g FROM members) t", "members")(lambda m: _next_group(m.select("group_id").distinct()))

# ---- 2.7, 2.8 arrays and hashes
query("ARR4_ARR5_positions", "SELECT file_id, round(greatest(5.0, duration * 0.1) + (duration - 2 * greatest(5.0, duration * 0.1)) * i / 4.0, 6) AS pos FROM files, (SELECT unnest([1, 2, 3]) AS i) t", "files")(lambda f: f.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.greatest(F.lit(5.0), F.col("duration") * 0.1) + (F.col("duration") - 2 * F.greatest(F.lit(5.0), F.col("duration") * 0.1)) * i / 4.0)).alias("p")).select("file_id", F.round("p", 6).alias("pos")))
query("ARR6_ORD9_scene_skip", "SELECT user_id, v[least(3, len(v))] AS skip, len(v[1:5])::INT AS first_n FROM (" + _SERIES + ") t", "points")(lambda p: series(p).select("user_id", F.element_at("v", F.least(F.lit(3), F.size("v"))).alias("skip"), F.size(F.slice("v", 1, 5)).alias("first_n")))
query("ARR7_sampling_plan", "SELECT file_id, CAST(n AS INT) AS n, round(CASE WHEN n = 1 THEN duration / 2.0 ELSE duration / CAST(n AS DOUBLE) * (n - 1) END, 6) AS last FROM (SELECT file_id, duration, least(30, greatest(1, ceil(duration / 60.0))) AS n FROM files) t", "files")(lambda f: f.withColumn("s", K.sample_positions(F.col("duration").cast("double"), 60.0, 30)).select("file_id", F.size("s").alias("n"), F.round(F.element_at("s", -1), 6).alias("last")))
query("ARR8_timeline_strip", "SELECT file_b AS clip, round(clip_offset * 100.0 / 60, 6) AS start_pct, greatest(0.5, least(100.0 - clip_offset * 100.0 / 60, 25.0)) AS width_pct FROM pairs", "pairs")(lambda p: p.select(F.col("file_b").alias("clip"), F.round(F.col("clip_offset") * 100.0 / 60, 6).alias("start_pct"), F.greatest(F.lit(0.5), F.least(100.0 - F.col("clip_offset") * 100.0 / 60, F.lit(25.0))).alias("width_pct")))
query("ARR9_flip", f"SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: i * f[((i - 1) // 8) * 8 + 8 - (i - 1) % 8])) AS BIGINT) AS digest FROM ({_PIX}) t", "@embeddings")(lambda e: pixels(e).withColumn("g", K.flip("f", 8)).select("vec_id", F.aggregate(F.transform("g", lambda x, i: (i + 1) * x), F.lit(0).cast("long"), lambda s, x: s + x).alias("digest")))
# A frame whose pixel (r, c) is the vector's value rr + 3rc + 7c, modulo its length; so a cell is the values' product with fixed weights.
_WEIGHTS = "SELECT cell, list(x ORDER BY k) AS w FROM (SELECT cell, (r * r + 3 * r * c + 7 * c) % 64 AS k, sum(cos((2 * c + 1) * (cell % 8 + 1) * pi() / 64) * cos((2 * r + 1) * (cell // 8 + 1) * pi() / 64)) AS x FROM range(64) t1(cell), range(32) t2(r), range(32) t3(c) GROUP BY 1, 2) t GROUP BY cell"
_CELLS = f"SELECT vec_id, list(list_dot_product(f::DOUBLE[], w) ORDER BY cell) AS a FROM ({_PIX}) p, ({_WEIGHTS}) q GROUP BY vec_id"
query("HSH1_perceptual_hash", f"SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN a[i + 1] <= m THEN 0::BIGINT WHEN i = 63 THEN -9223372036854775808 ELSE 1::BIGINT << i::INT END)) AS BIGINT) AS phash FROM (SELECT vec_id, a, (list_sort(a)[32] + list_sort(a)[33]) / 2 AS m FROM ({_CELLS}) u) w", "@embeddings")(
    lambda e: pixels(e).select("vec_id", K.perceptual_hash(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.element_at("f", ((F.floor(i / 32) * F.floor(i / 32) + 3 * F.floor(i / 32) * (i % 32) + 7 * (i % 32)) % 64 + 1).cast("int")))).alias("phash")))
_CH = [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 3) % 12) for i in range(12)] + [(i, (i + 6) % 12) for i in range(8)]
query("HSH2_chroma_bits", "SELECT vec_id, " + " + ".join(f"(CASE WHEN embedding[{a + 1}] > embedding[{b + 1}] THEN {1 << k} ELSE 0 END)::BIGINT" for k, (a, b) in enumerate(_CH)) + " AS fp FROM embeddings", "@embeddings")(lambda e: e.select("vec_id", K.chroma_bits("embedding").alias("fp")))
query("HSH3_unit", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings", "@embeddings")(lambda e: e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", F.round(F.element_at(K.unit("v"), 1), 6).alias("first")))
query("HSH6_bucket_vote", "SELECT user_id, pos // 8 AS bucket, " + " + ".join(f"(CASE WHEN sum((block >> {i}) & 1) >= count(*) // 2 + 1 THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(32)) + " AS vote FROM points GROUP BY user_id, pos // 8", "points")(
    lambda p: K.majority_vote(p.withColumn("k", F.struct("user_id", F.floor(F.col("pos") / 8).alias("bucket"))), "k", "block", 32).select("k.user_id", "k.bucket", "vote"))
query("HSH7_luma", "SELECT file_id, (299 * (file_id % 256) + 587 * (size_bytes % 256) + 114 * (mtime % 256)) // 1000 AS luma FROM files", "files")(lambda f: f.select("file_id", F.expr("(299 * (file_id % 256) + 587 * (size_bytes % 256) + 114 * (mtime % 256)) div 1000").alias("luma")))
query("HSH8_file_id", "SELECT file_id, substr(sha256(path), 1, 16) AS id FROM files", "files")(lambda f: f.select("file_id", F.substring(F.sha2("path", 256), 1, 16).alias("id")))

# ---- 2.9 scalars
query("SCL1_bytes_text", "SELECT file_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.1f B', b / 1.0) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS s FROM (SELECT file_id, size_bytes * 64 + 1 AS b FROM files) t", "files")(lambda f: f.select("file_id", S.bytes_text(F.col("size_bytes") * 64 + 1).alias("s")))
query("SCL2_duration_text", "SELECT file_id, CASE WHEN d >= 86400 THEN printf('%dd, %dh', d // 86400, d % 86400 // 3600) WHEN d >= 3600 THEN printf('%dh, %dm', d // 3600, d % 3600 // 60) WHEN d >= 60 THEN printf('%dm, %ds', d // 60, d % 60) ELSE printf('%ds', d) END AS s FROM (SELECT file_id, duration * 7 AS d FROM files) t", "files")(lambda f: f.select("file_id", S.duration_text(F.col("duration") * 7).alias("s")))
query("SCL3_megabytes", "SELECT file_id, (bit_rate * 1000) // 1048576 AS mb FROM files", "files")(lambda f: f.select("file_id", F.floor(F.col("bit_rate") * 1000 / 1048576).alias("mb")))
query("SCL5_relocate_prefix", "SELECT file_id, CASE WHEN starts_with(path, '/lib/src1/') THEN concat('/new/', substr(path, 11)) ELSE path END AS path FROM files", "files")(lambda f: f.select("file_id", S.relocate(F.col("path"), "/lib/src1", "/new").alias("path")))
query("SCL6_deconflict", "SELECT item_id, CASE WHEN rn = 1 THEN concat(p, '.x') ELSE concat(p, '_', CAST(rn - 1 AS STRING), '.x') END AS name FROM (SELECT item_id, regexp_replace(path, '[0-9]+$', '') AS p, row_number() OVER (PARTITION BY regexp_replace(path, '[0-9]+$', '') ORDER BY item_id) AS rn FROM members) t", "members")(
    lambda m: m.withColumn("p", F.regexp_replace("path", "[0-9]+$", "")).withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("item_id"))).select("item_id", F.when(F.col("rn") == 1, F.concat("p", F.lit(".x"))).otherwise(F.concat("p", F.lit("_"), (F.col("rn") - 1).cast("string"), F.lit(".x"))).alias("name")))
query("SCL7_path_equal", "SELECT count(DISTINCT lower(path)) AS folded, count(DISTINCT path) AS exact FROM files", "files")(lambda f: f.agg(F.countDistinct(F.lower("path")).alias("folded"), F.countDistinct("path").alias("exact")))
query("SCL8_frame_rate", "SELECT file_id, CASE WHEN channels = 0 THEN -1.0 ELSE round(fps * 1000.0 / channels, 6) END AS rate FROM files", "files")(lambda f: f.select("file_id", F.round(S.fraction(F.concat((F.col("fps") * 1000).cast("string"), F.lit("/"), F.col("channels").cast("string"))), 6).alias("rate")))
query("SCL9_csv_escape", "SELECT page_id, CASE WHEN contains(url, ',') OR contains(url, '\"') THEN concat('\"', replace(url, '\"', '\"\"'), '\"') ELSE url END AS cell FROM pages", "@pages")(lambda p: p.select("page_id", S.csv_quote(F.col("url")).alias("cell")))
query("SCL10_SCL11_explanation", "SELECT file_a, file_b, concat_ws(' · ', CASE p.method WHEN 'FrameSimilarity' THEN 'frame' WHEN 'AudioMatch' THEN 'audio' WHEN 'TimelineMatch' THEN 'timeline' END, concat(CAST(sim // 10 AS STRING), '%'), CASE WHEN clip_offset > 25 THEN concat('at ', CAST(clip_offset AS STRING), ' s') END) AS why FROM pairs p", "pairs")(
    lambda p: p.select("file_a", "file_b", F.concat_ws(" · ", S.method_label("method"), F.concat(F.floor(F.col("sim") / 10).cast("string"), F.lit("%")), F.when(F.col("clip_offset") > 25, F.concat(F.lit("at "), F.col("clip_offset").cast("string"), F.lit(" s")))).alias("why")))
query("SCL12_offset_text", "SELECT file_b, printf('@ %02d:%02d:%02d', o // 3600, o % 3600 // 60, o % 60) AS s FROM (SELECT file_b, clip_offset * 173 AS o FROM pairs) t", "pairs")(lambda p: p.select("file_b", S.offset_text(F.col("clip_offset") * 173).alias("s")))
query("SCL13_mime_range", "SELECT file_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'mp4' THEN 'video/mp4' WHEN 'mkv' THEN 'video/x-matroska' WHEN 'jpg' THEN 'image/jpeg' WHEN 'mp3' THEN 'audio/mpeg' ELSE 'application/octet-stream' END AS mime FROM files", "files")(lambda f: f.select("file_id", S.mime("path").alias("mime")))
query("SCL14_expression_helpers", "SELECT file_id FROM files WHERE length(path) > 18 AND contains(path, 'src') AND starts_with(path, '/lib')", "files")(lambda f: f.where("length(path) > 18 and contains(path, 'src') and startswith(path, '/lib')").select("file_id"))

# ---- 2.10 sorts, limits
for _n, _c in (("size", "size_bytes"), ("resolution", "frame_size"), ("duration", "duration"), ("date", "created"), ("similarity", "sim")):
    for _d in ("asc", "desc"):
        query(f"ORD1_ORD2_{_n}_{_d}", f"SELECT item_id, {_c} AS v FROM members ORDER BY {_c} {_d}, item_id", "members")(lambda m, c=_c, d=_d: m.select("item_id", F.col(c).alias("v")).orderBy(F.col("v").asc() if d == "asc" else F.col("v").desc(), "item_id"))
query("ORD1_group_sorts", "SELECT group_id, item_id, count(*) OVER g AS n, CAST(sum(size_bytes) OVER g AS BIGINT) AS total, bool_or(checked) OVER g AS any_checked FROM members WINDOW g AS (PARTITION BY group_id) ORDER BY total DESC, group_id, item_id", "members")(
    lambda m: m.select("group_id", "item_id", F.count_if(F.lit(True)).over(Window.partitionBy("group_id")).alias("n"), F.sum("size_bytes").over(Window.partitionBy("group_id")).alias("total"), F.bool_or("checked").over(Window.partitionBy("group_id")).alias("any_checked")).orderBy(F.desc("total"), "group_id", "item_id"))
query("ORD3_cluster_sort", "SELECT group_id, max(sim) AS top FROM members GROUP BY group_id ORDER BY top DESC, group_id", "members")(lambda m: m.groupBy("group_id").agg(F.max("sim").alias("top")).orderBy(F.desc("top"), "group_id"))
query("ORD4_page", "SELECT file_id, path FROM files ORDER BY path, file_id LIMIT 50 OFFSET 100", "files")(lambda f: f.select("file_id", "path").orderBy("path", "file_id").offset(100).limit(50))
query("ORD5_DML5_latest_job", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1", "@orders")(lambda o: o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey"))
query("ORD6_ORD11_by_name", "SELECT DISTINCT folder FROM files ORDER BY folder", "files")(lambda f: f.select("folder").distinct().orderBy("folder"))
query("ORD7_longest_first", "SELECT file_id, row_number() OVER (ORDER BY duration DESC, file_id) AS idx FROM files", "files")(lambda f: S.global_rank(f.select("file_id", "duration"), [F.col("duration").desc(), F.col("file_id").asc()], "idx").select("file_id", "idx"))
query("ORD8_report_order", "SELECT group_id, item_id, sim FROM members ORDER BY group_id, sim DESC, item_id", "members")(lambda m: m.select("group_id", "item_id", "sim").orderBy("group_id", F.desc("sim"), "item_id"))

# ---- 2.11 sets
query("SET1_difference", "SELECT item_id FROM members WHERE NOT checked", "members")(lambda m: m.select("item_id").exceptAll(m.where("checked").select("item_id")))
query("SET2_union", "SELECT folder FROM files WHERE is_image UNION SELECT folder FROM files WHERE size_bytes > 5000", "files")(lambda f: f.where("is_image").select("folder").union(f.where("size_bytes > 5000").select("folder")).distinct())
query("SET3_union_phases", "SELECT file_a, file_b, 'x' AS phase FROM pairs WHERE sim >= 900 UNION ALL SELECT file_a, file_b, 'y' AS phase FROM pairs WHERE clip_offset < 10", "pairs")(lambda p: p.where("sim >= 900").select("file_a", "file_b", F.lit("x").alias("phase")).unionByName(p.where("clip_offset < 10").select("file_a", "file_b", F.lit("y").alias("phase"))))
query("SET4_dedup_path", "SELECT folder, min(file_id) AS file_id FROM files GROUP BY folder", "files")(lambda f: f.groupBy("folder").agg(F.min("file_id").alias("file_id")))
query("SET6_distinct_methods", "SELECT file_a % 10 AS g, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM pairs GROUP BY 1", "pairs")(lambda p: p.groupBy((F.col("file_a") % 10).alias("g")).agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")))

# ---- 2.12 groups
_E = "SELECT file_a AS a, file_b AS b FROM pairs WHERE sim >= 800"
_CC = f"WITH RECURSIVE {{v}}e AS (SELECT a, b FROM ({_E}) x UNION SELECT b, a FROM ({_E}) y), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node"
ORACLE_SQL["GRP3_components"] = with_views(_CC.format(v="").replace("WITH RECURSIVE ", "WITH ", 1))
QUERIES["GRP3_components"] = lambda spark, d: G.clusters(view(spark, d, "pairs").where("sim >= 800").select(F.col("file_a").alias("a"), F.col("file_b").alias("b")))


def _hashed_pairs(p: DataFrame, d: DataFrame) -> DataFrame:
    h = word_hashes(d)
    return p.where("sim >= 800").select(F.col("file_a").alias("a"), F.col("file_b").alias("b")).join(h.select(F.col("id").alias("a"), F.col("hash").alias("ha")), "a").join(h.select(F.col("id").alias("b"), F.col("hash").alias("hb")), "b")


query("GRP1_constrained_groups", None, "pairs", "@documents")(lambda p, d: G.constrained_groups(_hashed_pairs(p, d), 20))
query("GRP2_split_chains", None, "pairs")(lambda p: G.split_chains(p.where("sim >= 600").select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))))
query("GRP8_pair_clusters", "SELECT least(a, b) AS cluster, a AS member FROM (" + _E + ") x UNION SELECT least(a, b), b FROM (" + _E + ") y", "pairs")(lambda p: G.pair_clusters(p.where("sim >= 800").select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))))
_E7 = _E.replace("800", "700")
_FIRST = f"SELECT node, min({{'a': a, 'b': b}}) AS m FROM (SELECT a AS node, a, b FROM ({_E7}) x UNION ALL SELECT b, a, b FROM ({_E7}) y) z GROUP BY node"
ORACLE_SQL["GRP4_timeline_groups"] = with_views(f"WITH f AS ({_FIRST}), t AS (SELECT x.node, CASE WHEN y.m < x.m THEN y.node ELSE x.m.a END AS parent FROM f x JOIN f y ON y.node = CASE WHEN x.node = x.m.a THEN x.m.b ELSE x.m.a END), r AS (SELECT node AS group_id, node AS member FROM t WHERE node = parent UNION ALL SELECT r.group_id, t.node FROM r JOIN t ON t.parent = r.member AND t.node <> t.parent) SELECT group_id, member FROM r")
query("GRP4_timeline_groups", None, "pairs")(lambda p: G.timeline_groups(p.where("sim >= 700").select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))))
query("GRP5_drop_singletons", "SELECT folder, file_id FROM (SELECT folder, file_id, count(*) OVER (PARTITION BY folder) AS n FROM files) t WHERE n > 1", "files")(lambda f: f.withColumn("n", F.count_if(F.lit(True)).over(Window.partitionBy("folder"))).where("n > 1").select("folder", "file_id"))
query("GRP6_drop_hardlinks", "SELECT file_id FROM (SELECT file_id, row_number() OVER (PARTITION BY codec, ino, dev ORDER BY file_id) AS rn FROM files) t WHERE rn = 1", "files")(lambda f: f.withColumn("rn", F.row_number().over(Window.partitionBy("codec", "ino", "dev").orderBy("file_id"))).where("rn = 1").select("file_id"))
query("GRP7_DML11_remove_group", "SELECT group_id, item_id FROM members WHERE group_id NOT IN (SELECT group_id FROM members WHERE item_id IN (5, 77))", "members")(lambda m: m.join(m.where("item_id in (5, 77)").select("group_id").distinct(), "group_id", "left_anti").select("group_id", "item_id"))
query("GRP9_best_in_group", "SELECT group_id, arg_max(item_id, (bitrate, -item_id)) AS best FROM members GROUP BY group_id", "members")(lambda m: m.groupBy("group_id").agg(F.max_by("item_id", F.struct("bitrate", -F.col("item_id"))).alias("best")))

# ---- 2.13 maintenance
query("DML2_point_get", "SELECT file_id, path, size_bytes FROM files WHERE file_id IN (3, 33)", "files")(lambda f: f.where("file_id in (3, 33)").select("file_id", "path", "size_bytes"))
query("DML3_DML6_remove_file_edges", "SELECT file_a, file_b FROM pairs WHERE file_a % 50 <> 7 AND file_b % 50 <> 7", "pairs")(lambda p: p.where("file_a % 50 <> 7 and file_b % 50 <> 7").select("file_a", "file_b"))
query("DML7_cleanup", "SELECT file_id FROM files WHERE (flags & 12) = 0 AND file_id % 9 <> 0", "files")(lambda f: f.where((F.col("flags").bitwiseAND(12) == 0) & (F.col("file_id") % 9 != 0)).select("file_id"))
query("DML8_prune_blacklist", "SELECT entry_id FROM blacklist b GROUP BY entry_id HAVING bool_and(path IN (SELECT folder FROM files WHERE file_id % 5 = 1))", "blacklist", "files")(
    lambda b, f: b.join(f.where("file_id % 5 = 1").select(F.col("folder").alias("x")).distinct(), F.col("path") == F.col("x"), "left").groupBy("entry_id").agg(F.bool_and(F.col("x").isNotNull()).alias("k")).where("k").select("entry_id"))
query("DML9_mark_excluded", "SELECT file_id, CASE WHEN file_id = 12 THEN flags | 1 ELSE flags END AS flags FROM files", "files")(lambda f: f.select("file_id", F.when(F.col("file_id") == 12, F.col("flags").bitwiseOR(1)).otherwise(F.col("flags")).alias("flags")))
query("DML10_DML12_action_plan", "SELECT item_id, CASE WHEN is_image THEN 'move' ELSE 'delete' END AS action, path AS source, CASE WHEN is_image THEN concat('/trash', path) END AS target FROM members WHERE checked", "members")(lambda m: m.where("checked").select("item_id", F.when(F.col("is_image"), "move").otherwise("delete").alias("action"), F.col("path").alias("source"), F.when(F.col("is_image"), F.concat(F.lit("/trash"), "path")).alias("target")))
query("DML13_blacklist_entries", "SELECT entry_id, array_to_string(list_sort(list(DISTINCT path)), '|') AS paths, count(DISTINCT path) AS n FROM blacklist GROUP BY entry_id", "blacklist")(lambda b: b.groupBy("entry_id").agg(F.array_sort(F.collect_set("path")).alias("p")).select("entry_id", F.array_join("p", "|").alias("paths"), F.size("p").cast("long").alias("n")))
query("STR1_progress_counts", "SELECT event_type, count(*) AS n, CAST(date_trunc('day', min(ts)) AS DATE) AS first_day FROM events GROUP BY event_type", "@events")(lambda e: e.groupBy("event_type").agg(one().alias("n"), F.to_date(F.min("ts")).alias("first_day")))

_TEN = ("size_bytes", "duration", "frame_size", "fps", "bitrate", "audio_rate", "sim", "created", "flags", "is_image")
query("FLT21_equal_in_all", f"SELECT group_id, {', '.join(_TEN)}, count(*) AS n FROM members GROUP BY ALL", "members")(lambda m: m.groupBy("group_id", *_TEN).agg(one().alias("n")))
query("DML2_by_path", "SELECT file_id, path FROM files WHERE path = (SELECT min(path) FROM files)", "files")(lambda f: f.join(f.agg(F.min("path").alias("path")), "path").select("file_id", "path"))
query("DML2_delete_and_count", "SELECT count(*) AS n FROM files WHERE folder <> '/lib/src2/d1'", "files")(lambda f: f.join(f.where("folder = '/lib/src2/d1'").select("file_id"), "file_id", "left_anti").agg(one().alias("n")))
query("DML3_add_edges", "SELECT DISTINCT least(a, b) AS file_a, greatest(a, b) AS file_b FROM (SELECT file_a AS a, file_b AS b FROM pairs UNION ALL SELECT file_b + 20, file_a FROM pairs WHERE sim > 900) t", "pairs")(
    lambda p: p.select("file_a", "file_b").union(p.where("sim > 900").select(F.col("file_b") + 20, "file_a")).select(F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b")).distinct())
query("DML4_blacklist_changes", "SELECT entry_id, path FROM blacklist WHERE entry_id <> 7 UNION SELECT 1000, folder FROM files WHERE is_image", "blacklist", "files")(
    lambda b, f: b.select(F.col("entry_id").cast("long").alias("entry_id"), "path").where("entry_id <> 7").union(f.where("is_image").select(F.lit(1000).cast("long"), "folder")).distinct())
query("DML6_cascade_delete", "SELECT file_a, file_b FROM pairs WHERE file_a NOT IN (SELECT file_id FROM files WHERE folder = '/lib/src2/d1') AND file_b NOT IN (SELECT file_id FROM files WHERE folder = '/lib/src2/d1')", "pairs", "files")(
    lambda p, f: p.join(g := f.where("folder = '/lib/src2/d1'").select(F.col("file_id").alias("gone")), F.col("file_a") == F.col("gone"), "left_anti").join(g, F.col("file_b") == F.col("gone"), "left_anti").select("file_a", "file_b"))
query("DML11_not_a_match", "SELECT entry_id, path FROM blacklist UNION ALL SELECT DISTINCT (SELECT max(entry_id) + 1 FROM blacklist), path FROM members WHERE group_id = (SELECT min(group_id) FROM members)", "blacklist", "members")(
    lambda b, m: b.select("entry_id", "path").union(m.join(m.agg(F.min("group_id").alias("group_id")), "group_id").select("path").distinct().join(b.agg((F.max("entry_id") + 1).alias("entry_id")), F.lit(True)).select("entry_id", "path")))

from kindred.plans import decisions, live  # noqa: E402, F401  (register their queries)
