"""Connected components by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, work: Workspace, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of edges (a, b) and of labels; label is the least node that can be reached.

    labels: components that are known, to which the edges are added. In each round a node takes its
    least neighbour (pre-aggregated, so a node of many edges is no hot spot) and that one's; then
    the edges are drawn between what their ends have become, and those inside one node go. Stars
    are gone after one round, so the edges shrink fast. Nothing but a flag reaches the driver.
    """
    if labels is not None:
        edges = _ends(edges, labels, "label")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = work.keep(both.filter("a <> b").distinct(), "edges")
    while not left.isEmpty():
        up = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up"))
        up = work.keep(up, "up")
        up = work.keep(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("above")), "up").select("node", F.col("above").alias("up")), "up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            known = labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            labels = known.unionByName(up.join(labels.select("node"), "node", "left_anti").select("node", F.col("up").alias("label")))
        labels = work.keep(labels, "labels")
        left = work.keep(_ends(left, up, "up").filter("a <> b").distinct(), "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def _ends(edges: DataFrame, to: DataFrame, column: str) -> DataFrame:
    """edges with each end replaced by what `to` (node, column) has for it."""
    for end in ("a", "b"):
        edges = edges.join(to.select(F.col("node").alias(end), F.col(column).alias("__to")), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return edges
