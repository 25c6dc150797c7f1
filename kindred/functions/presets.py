"""Named presets of expressions and the history of expressions, from logs of what users did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def presets(log: DataFrame, order: list[str]) -> DataFrame:
    """(owner, name, expression, added) from a log (owner, action, name, expression and the columns of its order, which tells rows apart).

    'save' adds a preset or replaces its expression in its place; 'delete' takes it away, and a
    later save adds it anew. added is the order of the save that added it: presets are listed
    by it. Blank names are ignored, as are other actions. Both steps are aggregations by owner
    and name, so a preset that is saved often is pre-aggregated where its rows lie.
    """
    at = F.struct(*order)
    rows = log.where(~_blank("name")).select("owner", "name", "action", "expression", at.alias("at"))
    gone = rows.where("action = 'delete'").groupBy(F.col("owner").alias("o_"), F.col("name").alias("n_")).agg(F.max("at").alias("gone_"))
    left = rows.where("action = 'save'").join(gone, F.col("owner").eqNullSafe(F.col("o_")) & (F.col("name") == F.col("n_")), "left").where("gone_ is null or at > gone_")
    return left.groupBy("owner", "name").agg(F.max_by("expression", "at").alias("expression"), F.min("at").alias("added"))


def history(log: DataFrame, order: list[str]) -> DataFrame:
    """(owner, expression, used) from a log (owner, expression and the columns of its order): each expression once, with its last use; the history lists the latest first. Blank expressions are ignored."""
    return log.where(~_blank("expression")).groupBy("owner", "expression").agg(F.max(F.struct(*order)).alias("used"))
