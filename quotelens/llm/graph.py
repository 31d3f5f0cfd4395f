"""Connected components of an edge table: every node learns the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); duplicates and loops do no harm, no edges give no rows.

    Rounds of taking the least label among neighbours and then the label of that label, until nothing changes. The joins are by
    node, so a hub is a skewed join key that Spark splits; each round is checkpointed and only a count reaches the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
    labels = cut(labels)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = cut(hooked.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("component")))
        changed = moved.where("component <> old").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
