"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each end of an edge ``a``, ``b``.

    Each round a node takes over the least label among its neighbours, and then
    that label's own label: what is known reaches twice as far, so a chain of n
    nodes takes about log n rounds. Labels are added up before they meet, and
    one side of each join has one row per node, so a node with most edges can
    be split. A round is a table in the shared folder; the driver sees whether
    anything changed.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        further = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        step = cut_lineage(lower.join(further, lower["to"] == further["at"]).select(
            "node", F.least("to", "beyond").alias("component"), "was"))
        labels = step.select("node", "component")
        if step.where("component != was").isEmpty():
            return labels
