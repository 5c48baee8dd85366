"""Connected components of a link table, as joins and minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links(a, b): the smallest node reachable.

    Each round every node takes the least label among its neighbours and
    itself, then the label of its label; a chain of n nodes needs about
    log n rounds. Both sides of each join are written tables, so that a
    node with very many links can be split over tasks.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = scratch.table(both.where("u <> v").distinct(), "edges")
    labels = scratch.table(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = scratch.table(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "step")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = scratch.table(step.join(jump, "component").select("node", "was", F.least("component", "root").alias("component")), "labels")
        scratch.drop(labels, step)
        labels = new
        if labels.where("component <> was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    scratch.drop(edges)
    return labels.select("node", "component")
