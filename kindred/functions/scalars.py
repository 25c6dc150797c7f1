"""Scalar functions over paths, sizes, durations and labels, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch

# File endings by kind, and media types for delivery.
IMAGE = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp")
VIDEO = ("mp4", "wmv", "avi", "mkv", "flv", "mov", "mpg", "mpeg", "m4v", "asf", "f4v", "webm", "divx", "m2t", "m2ts", "mts", "vob", "ts", "rmvb", "rm", "3gp", "ogv", "xvid", "hevc", "264", "265")
AUDIO = ("mp3", "flac", "wav", "ogg", "m4a", "aac")
MIMES = {"mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mov": "video/quicktime", "wmv": "video/x-ms-wmv", "flv": "video/x-flv", "ts": "video/mp2t", "ogv": "video/ogg", "3gp": "video/3gpp", "jpg": "image/jpeg", "png": "image/png", "mp3": "audio/mpeg"}
#: Words that a user's predicate may not hold anywhere.
FORBIDDEN = ("DROP", "DELETE", "DEFINE", "REMOVE", "CREATE", "UPDATE", "INSERT")


def extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def media_type(path: str) -> Column:
    e = extension(path)
    return F.when(e.isin(*IMAGE), "image").when(e.isin(*VIDEO), "video").when(e.isin(*AUDIO), "audio").otherwise("unknown")


def mime(path: str) -> Column:
    out = F.lit("application/octet-stream")
    for k, v in MIMES.items():
        out = F.when(extension(path) == k, v).otherwise(out)
    return out


def exif_time(s: Column) -> Column:
    """Seconds since 1970 of yyyy:MM:dd HH:mm:ss taken as UTC; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy:MM:dd HH:mm:ss")))


def within_folder(folder: Column, parent: str) -> Column:
    """The folder itself or one below; /a/b is not above /a/bc."""
    return (folder == parent) | folder.startswith(parent.rstrip("/") + "/")


def _glob(pattern: str, any_: str = ".") -> str:
    return "".join(f"{any_}*" if c == "*" else any_ if c == "?" else re.escape(c) for c in pattern)


def glob_hit(path: Column, pattern: str) -> Column:
    """Without a separator the pattern must match one path segment, whose * and ? stand for no separator; with one, the whole path."""
    if "/" in pattern:
        return path.rlike(f"^{_glob(pattern)}$")
    return path.rlike(f"(^|/){_glob(pattern, '[^/]')}(/|$)")


def glob_like(path: Column, pattern: str) -> Column:
    """The pattern occurs anywhere; * stands for anything."""
    return path.rlike(_glob(pattern))


def tail_folders(folder: str, depth: int) -> Column:
    """The last `depth` segments, lower-cased; shorter folders give what they have."""
    parts = F.split(folder, "/")
    return F.lower(F.array_join(F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)), depth), "/"))


def rejection(included: str = "/lib/src", excluded: tuple[str, ...] = ("/lib/src3",), least_image: int = 400, sizes: tuple[int, int] = (200, 20000), names: str = r"9.*\.txt$") -> Column:
    """The first reason, in this order, that keeps a file out of a scan; null if none.

    included: what folders must start with; excluded: folders that are left out with all below;
    least_image: images below this size are; sizes: of any file; names: a pattern of paths.
    """
    size, flags = F.col("size_bytes"), F.col("flags")
    out = F.when(F.col("is_image") & (size < least_image), "images off")
    for folder in excluded:
        out = out.when(within_folder(F.col("folder"), folder), "excluded folder")
    out = out.when(~F.col("folder").startswith(included), "not included").when(flags.bitwiseAND(1) > 0, "manual").when(flags.bitwiseAND(2) > 0, "too dark")
    return out.when(~size.between(*sizes), "size").when(F.col("path").rlike(names), "name")


def user_filter(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that a user's SQL predicate holds for. It is parsed as one expression, so it can't hold statements; a predicate with a forbidden word (anywhere, also as a part of a name) is refused."""
    for word in FORBIDDEN:
        if word in predicate.upper():
            raise ValueError(f"a predicate may not hold {word}")
    return df.where(F.expr(predicate))


def method_label(method: str) -> Column:
    return F.when(F.col(method) == "FrameSimilarity", "frame").when(F.col(method) == "AudioMatch", "audio").when(F.col(method) == "TimelineMatch", "timeline")


def csv_quote(s: Column, always: bool = False) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(s.rlike('[",\r\n]'), quoted).otherwise(s)


def bytes_text(b: Column) -> Column:
    """0 B, 512.0 B, 1.5 KB and so on, by 1024."""
    out = F.lit("0 B")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        out = F.when(b >= 1024**i, F.format_string(f"%.1f {unit}", b / float(1024**i))).otherwise(out)
    return out


def duration_text(d: Column) -> Column:
    """1d, 2h / 3h, 4m / 5m, 6s / 7s."""
    part = lambda per, of: F.floor((d if of is None else d % of) / per)
    return (
        F.when(d >= 86400, F.format_string("%dd, %dh", part(86400, None), part(3600, 86400)))
        .when(d >= 3600, F.format_string("%dh, %dm", part(3600, None), part(60, 3600)))
        .when(d >= 60, F.format_string("%dm, %ds", part(60, None), d % 60))
        .otherwise(F.format_string("%ds", d))
    )


def offset_text(o: Column) -> Column:
    return F.format_string("@ %02d:%02d:%02d", F.floor(o / 3600), F.floor(o % 3600 / 60), o % 60)


def relocate(path: Column, old: str, new: str) -> Column:
    """The path with a folder prefix replaced, at a segment's boundary only."""
    old, new = old.rstrip("/") + "/", new.rstrip("/") + "/"
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def fraction(s: Column) -> Column:
    """num/den as a number, -1 if it is none or den is 0."""
    p = F.split(s, "/")
    return F.coalesce(F.try_divide(F.try_element_at(p, F.lit(1)).try_cast("double"), F.nullif(F.try_element_at(p, F.lit(2)).try_cast("double"), F.lit(0.0))), F.lit(-1.0))


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, stop) of the first range of an HTTP Range header (both ends included), clipped to the size; null if there is none or it lies outside."""
    part = lambda k: F.regexp_extract(header, r"^bytes=\s*(\d*)\s*-\s*(\d*)", k).try_cast("long")
    start = F.when(part(1).isNull(), F.greatest(size - part(2), F.lit(0))).otherwise(part(1))
    stop = F.when(part(1).isNull() | part(2).isNull(), size - 1).otherwise(F.least(part(2), size - 1))
    return F.when(header.rlike(r"^bytes=\s*(\d+\s*-|-\s*[1-9])") & (start <= stop), F.struct(start.alias("start"), stop.alias("stop")))


def trim_millis(seconds: Column) -> Column:
    """Whole seconds of a duration."""
    return F.floor(seconds)


def global_rank(df: DataFrame, by: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Rank over all rows without one task for all: rows are dealt by range of the order and saved, so that counts and rows are of the same parts; parts are counted, and rows numbered within their part."""
    part = Scratch(df.sparkSession).save(df.repartitionByRange(buckets, *by).withColumn("part_", F.spark_partition_id()), "ranges")
    counts = part.groupBy("part_").agg(F.count_if(F.lit(True)).alias("n_"))
    counts = counts.withColumn("base_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    return part.join(counts, "part_").withColumn(name, F.col("base_") + F.row_number().over(Window.partitionBy("part_").orderBy(*by))).drop("part_", "base_")
