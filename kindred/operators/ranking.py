"""Best flags, keepers and selections within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (name, column, larger wins, of videos only)
CRITERIA = (
    ("duration", "duration", True, True), ("resolution", "frame_size", True, False), ("bitrate", "bitrate", True, True),
    ("fps", "fps", True, True), ("audio", "audio_rate", True, True), ("size", "size_bytes", True, False),
)
PRESETS = {"quality": ("resolution", "duration", "bitrate", "fps", "audio"), "web": ("duration", "resolution", "bitrate", "fps", "audio", "size")}


def resolve(names: list[str] | tuple[str, ...]) -> list[tuple[str, str, bool, bool]]:
    """Criteria in the user's order; unknown names are ignored and missing ones follow."""
    by = {c[0]: c for c in CRITERIA}
    first = [by[n] for n in dict.fromkeys(names) if n in by]
    return first + [c for c in CRITERIA if c not in first]


def order(names: list[str] | tuple[str, ...], only: bool = False) -> list[Column]:
    picked = [c for c in resolve(names) if not only or c[0] in names]
    out = []
    for _, col, larger, video in picked:
        x = F.when(~F.col("is_image"), F.col(col)) if video else F.col(col)
        out.append(x.desc_nulls_last() if larger else x.asc_nulls_last())
    return [*out, F.col("item_id").asc()]


def ranked(members: DataFrame, by: list[Column], name: str = "rn") -> DataFrame:
    return members.withColumn(name, F.row_number().over(Window.partitionBy("group_id").orderBy(*by)))


def best_flags(members: DataFrame) -> DataFrame:
    """Eight axes; all ties are flagged; size is best when smallest; axes of videos are null for images."""
    g = Window.partitionBy("group_id")
    out = members
    for name, col, larger, video in CRITERIA:
        big = larger and name != "size"
        top = (F.max(col) if big else F.min(col)).over(g)
        flag = F.col(col) == top
        out = out.withColumn(f"best_{name}", F.when(~F.col("is_image"), flag) if video else flag)
    return out.withColumn("best_sim", F.col("sim") == F.max("sim").over(g)).withColumn("best_created", F.col("created") == F.min("created").over(g))


def deletions(members: DataFrame, strategy: str) -> DataFrame:
    """All but the keeper of each group of two or more. keep: best quality, largest file, longest, best resolution, or only groups that are all 1000 thousandths alike."""
    by = {
        "lowest_quality": order(PRESETS["quality"], only=True),
        "smallest_file": [F.col("size_bytes").desc(), F.col("item_id")],
        "shortest": [F.col("duration").desc(), F.col("item_id")],
        "worst_resolution": [F.col("frame_size").desc(), F.col("item_id")],
        "identical_only": [F.col("size_bytes").desc(), F.col("item_id")],
    }[strategy]
    g = Window.partitionBy("group_id")
    out = ranked(members, by).withColumn("n", F.count_if(F.lit(True)).over(g)).withColumn("least", F.min("sim").over(g)).where("n > 1")
    out = out.where("least >= 1000") if strategy == "identical_only" else out
    return out.where("rn > 1").drop("rn", "n", "least")


#: What makes two members of a group the same, apart from the group.
IDENTITIES = {
    "full": ("size_bytes", "duration", "frame_size", "format", "audio_format", "audio_channel", "audio_rate", "bitrate", "fps"),
    "but_size": ("duration", "frame_size", "format", "audio_format", "audio_channel", "audio_rate", "bitrate", "fps"),
    "but_quality": (),
    "only_length": ("duration",),
}


def identical(members: DataFrame, identity: str) -> DataFrame:
    """Members with n_same, the number of others in their group that are the same by the identity; those without any are left out. Nulls are the same as nulls."""
    keys = ["group_id", *IDENTITIES[identity]]
    return members.withColumn("n_same", F.count_if(F.lit(True)).over(Window.partitionBy(*keys)) - 1).where("n_same > 0")


def group_order(members: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Members in the order of their group's size, total of sizes, or whether it has a checked one (key: size, total, checked), as column v; groups that tie stay together, by their ids.

    Groups are counted before the join, so a large group is partly counted where its rows lie.
    """
    value = {"size": F.count_if(F.lit(True)), "total": F.coalesce(F.sum("size_bytes"), F.lit(0)), "checked": F.coalesce(F.bool_or("checked"), F.lit(False))}[key]
    by = members.groupBy(F.col("group_id").alias("g_")).agg(value.alias("v"))
    out = members.join(by, F.col("group_id").eqNullSafe(F.col("g_"))).drop("g_")
    return out.orderBy(F.col("v").desc() if descending else F.col("v").asc(), "group_id", "item_id")
