"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rentweave.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node reachable.

    A round takes the smallest label among a node's neighbours and then that label's own
    label, so the distance covered grows at every round. Minima are combined before the
    shuffle and labels are unique on their side of each join, so a node with very many
    neighbours is split by adaptive execution. Every round is written once.
    """
    both = stage(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "graph"
    )
    labels = stage(
        both.groupBy("a").agg(F.min("b").alias("near")).select(
            F.col("a").alias("node"), F.least("a", "near").alias("component"), F.lit(True).alias("moved")
        ),
        "labels",
    )
    while labels.where("moved").limit(1).count():
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("near")).select(F.col("a").alias("node"), "near")
        )
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("via")
        )
        roots = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        labels = stage(
            step.join(roots, "via").select(
                "node", F.least("via", "root").alias("component"), (F.least("via", "root") < F.col("before")).alias("moved")
            ),
            "labels",
        )
    return labels.select("node", "component")
