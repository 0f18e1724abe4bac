"""Connected components of an edge table, by minimum labels and pointer jumping.

Every round is two equi-joins and partial aggregates over tables in the shared scratch folder;
nothing is collected but the number of labels that changed. A node of any degree is fine: its
edges meet only in partial minima and in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.storage import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for each node of an edge; the label is the component's smallest node."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        lower = materialise(lower, "cc-lower")  # as a scan, so that a large component's rows can be split in the join
        to = lower.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        jumped = lower.join(to, lower["label"] == to["via"], "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label"))
        jumped = materialise(jumped, "cc-jumped")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels
