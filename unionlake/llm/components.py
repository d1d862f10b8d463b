"""Connected components of links as iterated joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of the label, so labels travel twice as
    far each time; every round is written, so a lost executor costs a read.  A hub's links are summed up before they are
    shuffled."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = materialize(near.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels
