"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, label) for every node of ``edges`` (a, b): the smallest node of its component.

    In each round a node points to the smallest of itself and its neighbours, and the links move to
    what their ends point to; links within one node vanish. At least half of the nodes of every
    component vanish in a round, so rounds grow with the logarithm of the longest path. Every round
    is written to the shared folder; nothing but a count of links reaches the driver. None if there
    are no links.
    """
    left = scratch.write("links", edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        # Only ends that are the larger one of some link move; every other node stays.
        moved = scratch.write("moved", left.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "node"))
        steps.append(moved)
        to_a, to_b = moved.withColumnsRenamed({"node": "a", "to": "ta"}), moved.withColumnsRenamed({"node": "b", "to": "tb"})
        ends = left.join(to_a, "a", "left").join(to_b, "b").select(F.coalesce("ta", "a").alias("a"), F.col("tb").alias("b"))
        left = scratch.write("links", ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return None
    # A node that has moved in one round can move again in each later one.
    labels = steps[0]
    for i, later in enumerate(steps[1:], 1):
        follow = later.select(F.col("to").alias("next"), F.col("node").alias("to"))
        labels = labels.join(follow, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        new = later.join(labels.select("node"), "node", "left_anti")
        labels = scratch.write("labels", labels.unionByName(new)) if i % 2 == 0 or i == len(steps) - 1 else labels.unionByName(new)
    return labels.withColumnRenamed("to", "label")
