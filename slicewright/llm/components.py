"""Connected components of a graph given as a table of edges, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.session import drop_materialized, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node it is connected with.

    Each round points every node at its smallest neighbour, follows the pointers and drops what became a loop, so at least half
    of the nodes of every component go. Rounds are written to the shared folder. Nothing is collected.
    """
    labels = None
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select("b", "a"))
        jump = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).withColumn("to", F.least("node", "low")).drop("low"), "jump")
        # a node may point at one that itself points lower; one more step of each pointer is enough for progress
        if labels is None:
            labels, old = jump.withColumnRenamed("to", "root"), []
        else:
            moved = labels.join(jump, labels["root"] == jump["node"], "left").select(labels["node"], F.coalesce("to", "root").alias("root"))
            old, labels = [labels], materialize(moved, "labels")
        left = jump.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = jump.select(F.col("node").alias("b"), F.col("to").alias("y"))
        shorter = edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
        old.append(edges)
        edges = materialize(shorter, "edges")
        for table in old:
            drop_materialized(table)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return _settle(labels)


def _settle(labels: DataFrame) -> DataFrame:
    """Follow roots that are not their own roots; pointers only go down, so this ends."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = materialize(labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("changed")), "labels")
        if moved.where("changed").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")
