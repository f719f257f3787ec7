"""Connected components of links, by labels that only get smaller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlag.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node in ``links`` (``a, b``): the smallest node
    of its component.  Every round a node takes the smallest label of its
    neighbours and then that label's own label, so long chains shorten by
    doubling.  Labels stay in tables; only whether any changed is fetched."""
    edges = scratch(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                    .distinct(), "links")
    labels = scratch(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("comp"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        near = (edges.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        hooked = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("hook"))
        up = labels.select(F.col("node").alias("hook"), F.col("comp").alias("up"))
        labels = scratch(hooked.join(up, "hook").select(
            "node", F.least("hook", "up").alias("comp"),
            (F.least("hook", "up") < F.col("comp")).alias("changed")), "labels")
    return labels.select("node", "comp")
