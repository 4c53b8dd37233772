"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable by links) of every node of ``links`` (a, b).

    Each round a node takes the least label among its own, its neighbours' and that of the
    node its label names, so the number of rounds grows with the logarithm of a component's
    width. Each round's labels are written to the shared folder and read back. An empty
    table gives an empty one.
    """
    edges = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(
            F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge"))
        .select("edge.a", "edge.b")
        .distinct(),
        "edges",
    )
    labels = written(
        edges.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("component")
        ),
        "labels",
    )
    while True:
        of_node = labels.select(F.col("node").alias("b"), "component")
        seen = edges.join(of_node, "b").select(F.col("a").alias("node"), "component")
        named = labels.select("node", F.col("component").alias("b")).join(of_node, "b")
        offers = seen.unionByName(named.select("node", "component"))
        least = offers.groupBy("node").agg(F.min("component").alias("least"))
        new = written(
            labels.join(least, "node").select(
                "node",
                F.least("component", "least").alias("component"),
                (F.col("least") < F.col("component")).alias("changed"),
            ),
            "labels",
        )
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels
