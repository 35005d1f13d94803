"""Connected components of an edge table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.blocks import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    Every round takes the smallest label among a node's neighbours and then the
    label of its label, so chains shorten by half; a round ends in a checkpoint
    and the loop ends when no label changed.  Only that yes or no reaches the
    driver.  No edges give an empty table.  Edges with a null end are ignored.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = materialize(lower.join(jump, "component", "left")
                            .select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        done = after.where(F.col("old") != F.col("component")).isEmpty()
        labels = after.select("node", "component")
        if done:
            return labels
