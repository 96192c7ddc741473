"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.workspace import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); a component is named by its least node.

    Each round takes the least label around a node, then the label of that label, so long chains
    halve. Every round is a written table; the only thing that reaches the driver is a count.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                     .select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        around = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                  .agg(F.min("label").alias("near")))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(lower.join(jump, "label", "left")
                        .select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = after.select("node", "label")
        if not after.where("old <> label").limit(1).count():
            return labels.withColumnRenamed("label", "component")
