"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v of one type that can be compared); component is the least node it reaches.

    Each round a node takes the least label among its neighbours, then the
    label of its label. The labels are written to the shared folder after
    every round and only their number of changes comes to the driver. Every
    join is between tables read back from there, so adaptive execution can
    split a node of very many edges. Rounds grow with the logarithm of the
    longest path. An empty table gives an empty result.
    """
    edges = cut(edges.where("u <> v").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        took = labels.join(near, F.col("node") == F.col("u"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        took = cut(took, "took")
        jumped = took.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        after = cut(
            took.join(jumped, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "jump").alias("label")),
            "labels",
        )
        changed = after.where("old <> label").limit(1).count()
        discard(took)
        discard(labels)
        labels = after
        if not changed:
            discard(edges)
            return labels.select("node", F.col("label").alias("component"))
