"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.sources.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node of ``links`` (a, b): the smallest node that it reaches.

    A round takes the smallest label around each node, then that node's own label; labels at least halve
    their distance to the smallest, so rounds grow with the logarithm of the longest path. Each round
    is a written table, so that a lost executor costs one round's tasks. All sums are added up before
    they are shuffled: a node with very many links is no hot key.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = materialise(both.where("node <> other").distinct(), "links")
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = materialise(labels, "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        nearest = around.groupBy("node").agg(F.min("label").alias("m"))
        lowered = labels.join(nearest, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")
        )
        jumped = lowered.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        after = materialise(jumped.select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("label < old").limit(1).count() == 0:
            return labels
