"""Which files a scan takes and which it compares, by settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.scalars import _glob, glob_hit


@dataclass(frozen=True)
class ScanSettings:
    """included: folders; below: also what is below them; excluded: folders, whatever their case, or patterns with * or ?;
    sizes: least and greatest in bytes; must_match, must_not_match: patterns of whole paths, whatever their case."""

    included: tuple[str, ...]
    below: bool = True
    excluded: tuple[str, ...] = ()
    images: bool = True
    missing_too: bool = False
    links_too: bool = False
    sizes: tuple[int, int] | None = None
    must_match: tuple[str, ...] = ()
    must_not_match: tuple[str, ...] = ()


def under(folder: Column, parent: str) -> Column:
    """The folder itself or one below, but for those below whose path from the parent begins with a dot."""
    parent = parent.rstrip("/")
    return (folder == parent) | (folder.startswith(parent + "/") & ~folder.startswith(parent + "/."))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def scan_reasons(catalogue: DataFrame, listing: DataFrame, settings: ScanSettings) -> DataFrame:
    """The catalogue (path, folder, size_bytes, flags, is_image and more) with the first reason, in a fixed order, that keeps a file out of the scan; null if none.

    listing: (path, is_link) of the files there are. It is grouped by path and joined once, so
    a path listed twice gives no second row. Paths that are no UTF-8 can't be opened. A null
    folder is in no list, a null size in no range, null flags are none and a null path is missing.
    """
    there = listing.groupBy(F.col("path").alias("path_")).agg(F.bool_or("is_link").alias("link_"))
    folder, path, flags = F.col("folder"), F.col("path"), F.coalesce(F.col("flags"), F.lit(0))
    low = F.lower(folder)
    out_of = [glob_hit(folder, f) if set(f) & {"*", "?"} else under(low, f.lower()) for f in settings.excluded]
    inside = [under(folder, f) if settings.below else folder == f for f in settings.included]
    like = lambda ps: _any([path.rlike(f"(?is)^{_glob(p)}\\z") for p in ps])
    present = F.col("path_").isNotNull()
    reason = F.when(F.coalesce(F.col("is_image"), F.lit(False)) & F.lit(not settings.images), "images off").when(_any(out_of), "excluded folder").when(~_any(inside), "not included")
    reason = reason.when(flags.bitwiseAND(1) > 0, "manual").when(flags.bitwiseAND(2) > 0, "too dark").when(~present & F.lit(not settings.missing_too), "missing").when(~F.is_valid_utf8(path), "unsafe path")
    if settings.sizes:
        reason = reason.when(~F.coalesce(F.col("size_bytes").between(*settings.sizes), F.lit(False)), "size")
    if settings.must_match:
        reason = reason.when(~like(settings.must_match), "lacks pattern")
    reason = reason.when(present & F.col("link_") & F.lit(not settings.links_too), "link")
    if settings.must_not_match:
        reason = reason.when(like(settings.must_not_match), "has pattern")
    return catalogue.join(there, path == F.col("path_"), "left").withColumn("reason", reason).drop("path_", "link_")


def comparable(files: DataFrame, samples: DataFrame, least: int) -> DataFrame:
    """Files (file_id, is_image, has_info, invalid, failed) that can be compared: valid, probed, without a failed thumbnail, and videos with at least so many samples (file_id) stored. Nulls of invalid and failed are no, of has_info and is_image too."""
    n = samples.groupBy(F.col("file_id").alias("id_")).agg(F.count_if(F.lit(True)).alias("n_"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    enough = ~no("is_image") | (F.coalesce(F.col("n_"), F.lit(0)) >= least)
    return files.join(n, F.col("file_id") == F.col("id_"), "left").where(no("invalid") & ~no("has_info") & no("failed") & enough).drop("id_", "n_")
