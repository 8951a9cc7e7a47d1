"""Connected components of a graph whose edges are rows, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for each node in links(a, b); component is the smallest node that can be reached.

    Each round takes the least label among a node's neighbours, then the label of its label, which halves
    the way that is left; labels are written to the shared folder each round. Null nodes and loops link nothing.
    """
    spark = links.sparkSession
    links = links.where("a is not null and b is not null and a <> b")
    edges, edge_path = store.keep(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels, path = store.keep(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("least"))
        lower = labels.join(near, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        of_label = labels.toDF("component", "further")
        jumped = lower.join(of_label, "component", "left").select("node", F.least("component", "further").alias("component"), "was")
        new, new_path = store.keep(jumped, "labels")
        moved = new.where("component <> was").limit(1).count()
        store.drop(spark, path)
        labels, path = new.select("node", "component"), new_path
        if not moved:
            break
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    store.drop(spark, edge_path)
    return labels
