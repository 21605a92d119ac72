"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.frames import discard, stored


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the edges (a, b). With `rounds`, a
    smallest node seen after so many rounds: equal labels are connected, the reverse may not hold yet.

    Each round a node takes the smallest label around it and then the label of that label, so chains
    halve; edges stay distributed and only one number per round reaches the driver. Every round reads the
    edges anew, so they should be stored; repeated ones do no harm.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("label"))
    )
    done = 0
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")
        ).agg(F.min("label").alias("low"))
        nearer = labels.join(around, "node").select(
            "node", F.least("label", "low").alias("to"), F.col("label").alias("old")
        )
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        stepped = stored(
            nearer.join(jump, "to").select("node", F.least("to", "next").alias("label"), "old")
        )
        done += 1
        settled = done == rounds or stepped.filter("label <> old").isEmpty()
        discard(labels)
        labels = stepped.select("node", "label")
        if settled:
            return labels
