"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """v, comp for each end of edges (a, b): comp is the least v of its component.

    Each round a vertex takes the least label among its neighbours' and its own, then the label of that label, so paths
    halve; the number of rounds grows with the logarithm of the longest path. Labels stay in Spark; the driver sees counts.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.least("comp", "least").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("v").alias("at"), F.col("comp").alias("beyond"))
        moved = checkpointed(lower.join(jump, F.col("comp") == F.col("at")).select("v", F.least("comp", "beyond").alias("comp"), "was"))
        changed = moved.where("comp <> was").limit(1).count()
        labels = moved.select("v", "comp")
        if not changed:
            return labels
