"""Connected components of a table of links, in rounds of joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links`` (``a``, ``b``); the label is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours and then the label of its label, so paths
    halve at least. A round is a written table; only the number of changed labels comes to the driver. A node with
    very many links is one key of joins whose both sides are plain exchanges, which adaptive execution splits.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = staged(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = staged(stepped.join(jump, "label").select("node", F.col("next").alias("label"), "was"), "labels")
        changed = labels.filter("label < was").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
