"""Connected components of a large graph, by joins of one row an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round gives a node the smallest label around it and then that label's own label, until a
    round moves nothing.  Labels are checkpointed, so a lost executor costs no earlier round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = reliable_checkpoint(both)
    labels = reliable_checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        # Reading b -> label(b) through b's own row: hot nodes are spread by the join's skew handling.
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jumped = least.alias("l").join(labels.select(F.col("node").alias("to"), F.col("label").alias("next")).alias("r"), "to")
        stepped = reliable_checkpoint(jumped.select("node", F.col("label").alias("old"), F.least("to", "next").alias("label")))
        moved = stepped.where("old <> label").limit(1).count()
        labels = stepped.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
