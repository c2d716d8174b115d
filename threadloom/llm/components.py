"""Connected components of a link table, by label propagation with shortcuts over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b), undirected, lead to; nodes without links are left out.

    Each round takes the least label among a node's neighbours, then that label's own
    label, so chains shrink by powers. Neighbours are reduced by a partial aggregate and
    joins run on plain exchanges, so a node with very many links is split by Spark.
    """
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("_old"), F.least("root", F.coalesce("_near", "root")).alias("root"))
        up = labels.select(F.col("node").alias("_up"), F.col("root").alias("_over"))
        labels = stored(lower.join(up, lower["root"] == up["_up"], "left").select("node", "_old", F.least("root", F.coalesce("_over", "root")).alias("root")), "labels")
        if labels.filter("root != _old").isEmpty():
            return labels.select("node", "root")
