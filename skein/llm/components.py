"""Connected components of a link table, distributed: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); the component is its smallest node.

    In each round a node takes the least label around it and then that label's own label, so that the rounds grow
    with the logarithm of the longest path. Rounds are checkpointed into the shared folder; only a count of changes
    reaches the driver.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"))
    for _ in range(max_rounds):
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(around, F.col("node") == F.col("a")).select("node", "component", F.least("component", "least").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        # many nodes share a label: it is looked up once and joined back by the label, which splits under skew
        moved = checkpointed(lower.join(far, "to").select("node", F.least("to", "beyond").alias("component"), (F.least("to", "beyond") < F.col("component")).alias("changed")))
        labels = moved.select("node", "component")
        if not moved.where("changed").limit(1).count():
            return labels
    raise RuntimeError("the components did not settle")
