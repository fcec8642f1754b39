"""Connected components of links between nodes, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import session


def components(links: DataFrame) -> DataFrame:
    """node, label: every node of ``links`` (a, b) with the least node it can reach.

    Each round gives a node the least label among its neighbours' and its own, then the label of that label; both
    combine before they are shuffled, so a node with any number of links costs no task more. Ends when
    nothing changes; every round is a written table.
    """
    spark = links.sparkSession
    both = session.written(spark, links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = session.written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = session.written(spark, labels.join(seen, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"),
                                                                                F.col("label").alias("was")), "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = session.written(spark, least.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
