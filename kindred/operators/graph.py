"""Connected components by contraction: every node hooks to its least neighbour, chains are
halved by pointer jumping, and the graph shrinks to its roots until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of an edge list; component is the least node reachable.

    Edges are undirected; loops, repeats and rows with a null end are ignored. An empty
    edge list gives an empty result. Nothing is gathered in one place: hot nodes are
    pre-aggregated by the partial min and split by the adaptive skew join.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    kind = edges.schema[src].dataType
    a, b = F.col(src), F.col(dst).cast(kind)
    live = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    live = scratch.save(live, "edges")
    label: DataFrame | None = None
    while not live.isEmpty():
        ends = live.union(live.select("b", "a"))
        parent = ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        parent = scratch.save(parent, "hook")
        while True:
            up = parent.select(F.col("v").alias("uv"), F.col("p").alias("up"))
            jumped = parent.join(up, F.col("p") == F.col("uv"), "left").select("v", F.coalesce("up", "p").alias("p"), (F.col("up") < F.col("p")).alias("moved"))
            jumped = scratch.save(jumped, "jump")
            moved = not jumped.where("moved").isEmpty()
            scratch.drop(parent)
            parent = jumped
            if not moved:
                break
        root = parent.select("v", "p")
        left = live.join(root, F.col("a") == F.col("v")).select(F.col("p").alias("ra"), "b")
        both = left.join(root, F.col("b") == F.col("v")).select("ra", F.col("p").alias("rb"))
        rest = both.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = scratch.save(rest, "edges")
        if label is None:
            label = root.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            again = root.select("v", "p")
            label = scratch.save(label.join(again, F.col("component") == F.col("v"), "left").select("node", F.coalesce("p", "component").alias("component")), "label")
        live = rest
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return label
