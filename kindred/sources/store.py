"""File discovery, JSON stores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.sources.versioned import Files


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = S.IMAGE + S.VIDEO, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, folder, size_bytes, date_modified) of files below root by extension, without excluded folders; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("date_modified"))
    found = found.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).where(S.extension("path").isin(*extensions))
    for e in excluded:
        found = found.where(~S.within_folder(F.col("folder"), e))
    return found.select("path", "folder", "size_bytes", "date_modified")


def parse_blacklist(texts: DataFrame, column: str = "value") -> DataFrame:
    """(entry_id, path) of blacklist JSON: a bare array of path lists (version 0) or {version, groups}. Text that is neither gives none."""
    v1 = F.from_json(column, "version int, groups array<array<string>>")["groups"]
    v0 = F.from_json(column, "array<array<string>>")
    groups = F.when(F.col(column).rlike(r"^\s*\{"), v1).otherwise(v0)
    return texts.select(F.posexplode(groups).alias("entry_id", "paths")).select("entry_id", F.explode("paths").alias("path"))


def parse_results(texts: DataFrame, item: str, column: str = "value") -> DataFrame:
    """Items of a results file: {version, items} or a bare array."""
    v1 = F.from_json(column, f"version int, items array<struct<{item}>>")["items"]
    items = F.when(F.col(column).rlike(r"^\s*\{"), v1).otherwise(F.from_json(column, f"array<struct<{item}>>"))
    return texts.select(F.explode(items).alias("i")).select("i.*")


def quarantined(texts: DataFrame, column: str = "value") -> DataFrame:
    """The rows of texts that hold neither version of a blacklist: to be set aside, not lost."""
    v1 = F.from_json(column, "version int, groups array<array<string>>")["groups"]
    return texts.where(F.coalesce(F.when(F.col(column).rlike(r"^\s*\{"), v1).otherwise(F.from_json(column, "array<array<string>>")).isNull(), F.lit(True)))


def blacklist_json(entries: DataFrame) -> DataFrame:
    """(value): one row, version 1 of the blacklist's JSON, from (entry_id, path). A blacklist is one document by its format and small."""
    groups = entries.groupBy("entry_id").agg(F.array_sort(F.collect_set("path")).alias("p")).agg(F.array_sort(F.collect_list(F.struct("entry_id", "p"))).alias("g"))
    return groups.select(F.to_json(F.struct(F.lit(1).alias("version"), F.col("g.p").alias("groups"))).alias("value"))


def results_json(items: DataFrame, version: int = 1) -> DataFrame:
    """(value): one row, {version, items}, from the rows of items."""
    return items.agg(F.collect_list(F.struct("*")).alias("items")).select(F.to_json(F.struct(F.lit(version).alias("version"), "items")).alias("value"))


RESULTS_HEAD, BLACKLIST_HEAD, TAIL = '{"version":1,"items":[', '{"version":1,"groups":[', "]}"


def _as_lines(elements: DataFrame, order: list[str], head: str) -> DataFrame:
    """(line, value): the lines of one JSON document with an element (value) a line, numbered in the given order; no task holds the document."""
    ranked = S.global_rank(elements, [F.col(c) for c in [*order, "value"]], "line_")
    body = ranked.select(F.col("line_").cast("long").alias("line"), F.concat(F.when(F.col("line_") > 1, ",").otherwise(""), "value").alias("value"))
    return body.union(elements.sparkSession.createDataFrame([(0, head), (1 << 62, TAIL)], body.schema))


def results_lines(items: DataFrame, order: list[str]) -> DataFrame:
    """{version, items} with an item a line."""
    return _as_lines(items.select(*order, F.to_json(F.struct(*items.columns)).alias("value")), order, RESULTS_HEAD)


def blacklist_lines(entries: DataFrame) -> DataFrame:
    """{version, groups} of (entry_id, path), with a group a line, in order of entry_id."""
    groups = entries.groupBy("entry_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return _as_lines(groups.select("entry_id", F.to_json("paths").alias("value")), ["entry_id"], BLACKLIST_HEAD)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files that are the document when put one after the other."""
    lines.orderBy("line").select("value").write.mode("overwrite").text(path)


def _elements(spark: SparkSession, path: str, head: str) -> tuple[DataFrame, DataFrame]:
    """(line, value) of the elements of files of lines, in order, and the lines that hold a whole document (of either version)."""
    text = spark.read.text(path).where("trim(value) <> ''")
    at = text.select("value", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("turn_"))
    whole = F.col("value").rlike(r'^\s*\{\s*"version".*\}\s*$') | F.col("value").rlike(r"^\s*\[\s*[\[{].*\]\s*$") | (F.trim("value") == "[]")
    single = at.where(~whole & (F.col("value") != head) & (F.col("value") != TAIL)).withColumn("value", F.regexp_replace("value", "^,", ""))
    return S.global_rank(single, [F.col(c) for c in ("file_", "block_", "turn_")], "line").select("line", "value"), text.where(whole)


def read_results(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of results files, written a line an item or as one line of either version. An element that can't be read has null fields."""
    single, whole = _elements(spark, path, RESULTS_HEAD)
    return single.select(F.from_json("value", f"struct<{item}>").alias("i")).select("i.*").unionByName(parse_results(whole, item))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, path) of blacklist files, numbered as they stand."""
    single, whole = _elements(spark, path, BLACKLIST_HEAD)
    groups = single.select((F.col("line") - 1).cast("int").alias("entry_id"), F.explode(F.from_json("value", "array<string>")).alias("path"))
    return groups.unionByName(parse_blacklist(whole))


#: The columns of the group report, in their order, and how a member gives them.
GROUP_COLUMNS = ("GroupId", "Similarity", "Path", "Size", "Duration", "FrameSize", "Format", "Fps", "BitRateKbs", "AudioFormat", "DateCreated", "IsImage", "Flags", "PartialClipOffset")
PAIR_COLUMNS = ("Similarity", "Method", "ClipOffsetSecs", "PathA", "SizeA", "DurationA", "WidthA", "HeightA", "PathB", "SizeB", "DurationB", "WidthB", "HeightB")


def group_report(members: DataFrame) -> DataFrame:
    """The 14 columns of the group report as text, by group and falling similarity; members need those of the members view."""
    text = lambda c: F.col(c).cast("string")
    given = {
        "GroupId": text("group_id"), "Similarity": F.format_string("%.1f", F.col("sim") / 10.0), "Path": F.col("path"), "Size": text("size_bytes"), "Duration": F.format_string("%.3f", F.col("duration").cast("double")),
        "FrameSize": text("frame_size"), "Format": S.extension("path"), "Fps": F.format_string("%.2f", F.col("fps").cast("double")), "BitRateKbs": text("bitrate"), "AudioFormat": text("audio_rate"),
        "DateCreated": F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd'T'HH:mm:ss"), "IsImage": F.when(F.col("is_image"), "True").otherwise("False"), "Flags": text("flags"), "PartialClipOffset": F.lit("0"),
    }
    return members.orderBy("group_id", F.desc("sim"), "item_id").select(*[given[c].alias(c) for c in GROUP_COLUMNS])


def pair_report(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The 13 columns of the pair report as text; files that are gone have empty paths and zeros."""
    side = lambda s: files.select(F.col("file_id").alias(f"file_{s.lower()}"), F.col("path").alias(f"Path{s}"), F.col("size_bytes").cast("string").alias(f"Size{s}"), F.format_string("%.3f", F.col("duration").cast("double")).alias(f"Duration{s}"), F.col("width").cast("string").alias(f"Width{s}"), F.col("height").cast("string").alias(f"Height{s}"))
    out = pairs.join(side("A"), "file_a", "left").join(side("B"), "file_b", "left")
    own = [F.format_string("%.4f", F.col("sim") / 1000.0).alias("Similarity"), S.method_label("method").alias("Method"), F.coalesce(F.format_string("%.3f", F.col("clip_offset").cast("double")), F.lit("")).alias("ClipOffsetSecs")]
    empty = {"Path": "", "Size": "0", "Duration": "0.000", "Width": "0", "Height": "0"}
    return out.select(*own, *[F.coalesce(c, F.lit(empty[c[:-1]])).alias(c) for c in PAIR_COLUMNS[3:]])


def pair_text(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(file_a, file_b, text): the entry of each pair in the text report, of three lines and an empty one; files that are gone are question marks."""
    side = lambda s: files.select(F.col("file_id").alias(f"file_{s}"), F.col("path").alias(f"path_{s}"))
    offset = F.when(F.col("clip_offset").isNotNull(), F.format_string("  offset %.1fs", F.col("clip_offset").cast("double"))).otherwise("")
    head = F.concat(F.format_string("  [%.1f%% via ", F.col("sim") / 10.0), S.method_label("method"), offset, F.lit("]"))
    text = F.concat_ws("\n", head, *[F.concat(F.lit(f"    {s.upper()}: "), F.coalesce(f"path_{s}", F.lit("?"))) for s in "ab"], F.lit(""))
    return pairs.join(side("a"), "file_a", "left").join(side("b"), "file_b", "left").select("file_a", "file_b", text.alias("text"))


def pair_text_lines(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(value): the whole text report, its heading first, then pairs by their ids; without pairs, one line that says so."""
    n = pairs.agg(F.count_if(F.lit(True)).alias("n"))
    head = n.select(F.lit(None).cast("long").alias("file_a"), F.lit(None).cast("long").alias("file_b"), F.when(F.col("n") > 0, F.format_string("\n=== %d duplicate pair(s) ===\n", "n")).otherwise("No duplicates found.").alias("text"))
    entries = pair_text(pairs, files).select(F.col("file_a").cast("long"), F.col("file_b").cast("long"), "text")
    return head.union(entries).orderBy("file_a", "file_b").select(F.col("text").alias("value"))


def csv_lines(report: DataFrame) -> DataFrame:
    """(line): a report's rows as CSV, cells quoted where needed."""
    return report.select(F.concat_ws(",", *[S.csv_quote(F.col(c)) for c in report.columns]).alias("line"))


def group_text(members: DataFrame) -> DataFrame:
    """(group_id, item_id, text): the entry of each member in the text report."""
    facts = F.when(F.col("is_image"), F.format_string("         %d, %s", "frame_size", S.extension("path"))).otherwise(F.format_string("         %d, %s, %.2f fps, %d kbps, %s", "frame_size", S.extension("path"), F.col("fps").cast("double"), "bitrate", F.date_format(F.timestamp_seconds("duration"), "HH:mm:ss")))
    best = F.when((F.col("bitrate") == F.max("bitrate").over(Window.partitionBy("group_id"))) | (F.col("frame_size") == F.max("frame_size").over(Window.partitionBy("group_id"))), " [best]").otherwise("")
    return members.withColumn("best", best).select("group_id", "item_id", F.concat(F.format_string("  %6.1f%%  ", F.col("sim") / 10.0), F.col("path"), F.col("best"), F.lit("\n"), facts).alias("text"))


PAIR_JSON = "similarity float, method string, clip_offset_secs double, file_a struct<id:string, path:string, name:string, size_bytes:bigint, duration_secs:double, width:int, height:int>, file_b struct<id:string, path:string, name:string, size_bytes:bigint, duration_secs:double, width:int, height:int>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from files that each hold a JSON array of them."""
    return spark.read.schema(PAIR_JSON).option("multiLine", True).json(path)


def pair_json(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(value): a JSON object for each pair both of whose files are known, as read_pairs reads it."""
    file = lambda s: files.select(F.col("file_id").alias(f"file_{s}"), F.struct(F.col("file_id").cast("string").alias("id"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("size_bytes").cast("long").alias("size_bytes"), F.col("duration").cast("double").alias("duration_secs"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).alias(s))
    both = pairs.join(file("a"), "file_a").join(file("b"), "file_b")
    return both.select(F.to_json(F.struct((F.col("sim") / 1000.0).cast("float").alias("similarity"), S.method_label("method").alias("method"), F.col("clip_offset").cast("double").alias("clip_offset_secs"), F.col("a").alias("file_a"), F.col("b").alias("file_b"))).alias("value"))


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """csv (quoted where needed), json, text or parquet. The new report is written beside the old one; that is moved aside, the new one takes its place, and only then the old one goes. A report that a stop between the two moves left aside is moved back first."""
    files, name = Files(df.sparkSession, path.rsplit("/", 1)[0]), path.rsplit("/", 1)[1]
    new, old = f"{name}.new", f"{name}.old"
    if files.exists(old) and not files.exists(name):
        files.move(old, name)
    writer, beside = df.write.mode("overwrite"), f"{files.root}/{new}"
    writer.option("header", True).option("quote", '"').option("escape", '"').csv(beside) if kind == "csv" else writer.format(kind).save(beside)
    files.delete(old)
    if files.exists(name):
        files.move(name, old)
    files.move(new, name)
    files.delete(old)


def synthetic_files(spark: SparkSession, n: int, groups: int = 0, group_size: int = 0, seed: int = 42) -> DataFrame:
    """A seeded catalogue of n files, and groups of near copies with the first's facts."""
    pick = lambda name, lo, hi: (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "base"), F.lit(hi - lo + 1)) + lo).alias(name)
    ids = spark.range(n).select("id", F.col("id").alias("base")).union(spark.range(groups * group_size).select(F.col("id") + n, F.floor(F.col("id") / max(1, group_size))))
    return ids.select(F.col("id").alias("file_id"), pick("duration", 5, 3600), pick("size_bytes", 5 << 20, 250 << 20), pick("width", 640, 3840), pick("height", 360, 2160), pick("bit_rate", 1_000_000, 20_000_000), pick("fps", 24, 60))
