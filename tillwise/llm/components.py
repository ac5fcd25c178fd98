"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.workspace import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each end of an edge.

    ``edges`` has the columns ``a`` and ``b``. Each round takes over the
    smallest label among the neighbours and then the label's own label, so long
    chains shorten by half or better. Labels meet by aggregation with partial
    sums, and the joins have one row per node on one side, so that adaptive
    execution can split a node or a label with most of the edges. Each round is
    written to the shared folder. The driver sees one count a round.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        .where("a != b").distinct(), "edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a").agg(F.min("component").alias("near")))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        far = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        step = written(
            lower.join(far, lower["to"] == far["at"])
            .select("node", F.least("to", "beyond").alias("component"), "was"), "labels")
        labels = step.select("node", "component")
        if step.where("component != was").isEmpty():
            return labels
