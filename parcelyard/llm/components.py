"""Connected components of an edge table, by minimum labels and pointer jumping in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b): label is the smallest node it is linked with.

    Every round takes the smallest label among neighbours and then the label of that label, so paths
    shrink by more than half. Edges and labels stay distributed; each round is written to the shared
    folder, which cuts the lineage and survives lost executors. No edges give no rows.
    """
    both = Stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = Stored(both.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.df.join(labels.df.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = Stored(labels.df.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        jump = hooked.df.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = Stored(hooked.df.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        hooked.drop()
        labels.drop()
        labels = after
        if not labels.df.where("old <> label").limit(1).count():
            both.drop()
            return labels.df.select("node", "label")
