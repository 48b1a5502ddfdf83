"""Connected components of an edge table, by repeated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, small


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node it is connected with.

    Each round takes every label's own label (pointer jumping) and then the smallest among the neighbours', for
    itself and for the node that was its label, so the number of rounds grows with the logarithm of the longest path. Labels are broadcast while they are few (see `small`); beyond
    that both sides of each join are plain scans, which lets AQE split a hub's rows.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    both = materialize(once.select(ways.alias("e")).select("e.*"), "edges", few=True)
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = materialize(labels, "labels", few=True)
    while True:
        up = small(labels).select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = labels.join(up, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))
        jumped = materialize(jumped, "labels", few=True)
        near = both.join(small(jumped.withColumnRenamed("node", "v")), "v").groupBy("u").agg(F.min("label").alias("m"))
        known = small(jumped)
        told = near.withColumnRenamed("u", "node").join(known, "node").select(F.explode(F.array("node", "label")).alias("node"), "m").groupBy("node").agg(F.min("m").alias("m"))
        new = told.join(known, "node")
        new = materialize(new.select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")), "labels", few=True)
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
