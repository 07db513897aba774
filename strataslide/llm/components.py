"""Connected components of an edge table, by smallest label, without collecting links.

Each round every node takes the smallest label among itself and its neighbours, then the
label of that label (pointer jumping), so long chains shrink fast. Every round is written
to the shared folder; the loop ends when no label changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node reachable, for nodes with an edge."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = keep(step.join(jump, "next", "left").select("node", F.col("component").alias("was"), F.least("next", F.coalesce("further", "next")).alias("component")), "labels")
        drop(labels)
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            drop(both)
            return labels
