"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import staged


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) for (node long) and undirected (a long, b long): the label is the smallest node of the component.

    Nodes take the smallest label that a neighbour has, and labels then follow labels (a label is a node, so its own label is nearer to
    the root), which halves the way at least in long chains.  Rounds end when nothing changes; each is written, so
    a lost executor costs one round.
    """
    both = staged(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = staged(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        # The label's owner hears of a smaller one too, so whole groups move at once.
        took = labels.join(near, "node").where("near < label").select(F.col("label").alias("node"), "near").groupBy("node").agg(F.min("near").alias("hook"))
        hooked = labels.join(near, "node", "left").join(took, "node", "left").select("node", "label", F.least("label", "near", "hook").alias("next"))
        hooked = staged(hooked, "hooked")
        above = hooked.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        labels_next = staged(hooked.join(above, "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved")), "labels")
        labels = labels_next.select("node", "label")
        if labels_next.where("moved").isEmpty():
            return labels
