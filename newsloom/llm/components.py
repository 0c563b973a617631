"""Connected components of links between documents, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links (a, b)``; a component is its smallest node.

    Every round a node takes the smallest label among itself and its neighbours, then the label of that
    label, so long chains halve. Labels are written to the shared folder between rounds.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "edges")
    labels = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels"
    )
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("taken"))
        target = labels.select(F.col("node").alias("taken"), F.col("component").alias("further"))
        new = materialize(
            taken.join(target, "taken").select("node", F.least("taken", "further").alias("component"), (F.least("taken", "further") != F.col("component")).alias("moved")),
            "labels",
        )
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
