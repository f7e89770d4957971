"""Connected components of a graph of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node of its component.

    Every round takes the smallest label among a node's neighbours, then the label's own label, so a
    path shortens by half or better each round; a round's labels are checkpointed. No component or
    neighbourhood is gathered in one place. Loops, repeated and reversed edges make no difference; no
    edges give no rows."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near["at"], "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = checkpointed(step)
        roots = step.select(F.col("node").alias("root"), F.col("label").alias("top"))
        jumped = step.join(roots, step.label == roots.root, "left").select("node", "was", F.least("label", "top").alias("label"))
        jumped = checkpointed(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("label <> was").isEmpty():
            return labels
