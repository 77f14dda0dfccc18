"""Connected components of links, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, gathered, staged_as


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (a, b), a staged table or some, since they are counted first.

    Each round every node takes the least label among its neighbours, then the
    label of its label, so that long chains halve. The rounds end when no
    label changes; each is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    ends = 2 * links.count()
    edges, edges_at = staged_as(gathered(both, ends), "edges")
    labels, at = staged_as(gathered(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), ends), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("_near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", "component", F.least("component", F.coalesce("_near", "component")).alias("_new"))
        jump = labels.select(F.col("node").alias("_of"), F.col("component").alias("_jump"))
        new = lower.join(jump, lower._new == jump._of, "left").select("node", F.least("_new", F.coalesce("_jump", "_new")).alias("component"), F.col("component").alias("_was"))
        moved, moved_at = staged_as(gathered(new, ends), "labels")
        done = moved.filter("component <> _was").isEmpty()
        drop_staged(at)
        labels, at = moved.select("node", "component"), moved_at
        if done:
            drop_staged(edges_at)
            return labels
