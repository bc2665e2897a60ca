"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b: long); the label is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by pointer
    doubling and contracts the links; a component loses at least half of its nodes a round. Aggregates
    combine map-side, joins are on node keys; self-links and repeated links are harmless.
    """
    edges = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        parent = materialize(parent, "hooks")
        while True:
            above = parent.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            step = parent.join(above, F.col("up") == F.col("n2")).select("node", F.col("up2").alias("up"), (F.col("up2") < F.col("up")).alias("moved"))
            step = materialize(step, "hooks")
            parent = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.withColumnRenamed("up", "label")
        else:
            # every label that still has links gets its root; the others stay
            root = parent.select(F.col("node").alias("n2"), "up")
            labels = labels.join(root, F.col("label") == F.col("n2"), "left").select("node", F.coalesce("up", "label").alias("label"))
            labels = materialize(labels, "labels")
        up_a = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        up_b = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(up_a, "a").join(up_b, "b").filter("ua <> ub")
        edges = materialize(edges.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, label long")
    return labels
