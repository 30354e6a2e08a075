"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id of ``edges(a, b)``; the component is its smallest reachable id.

    Each round gives a node the smallest label among itself and its neighbours,
    then the label of that label, until nothing changes.  Labels are written
    each round; hubs are pre-aggregated before they are shuffled.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        step = written(step, "step")
        jump = step.select(F.col("id").alias("at"), F.col("new").alias("component"))
        after = step.join(jump, step["new"] == jump["at"], "left").select("id", "old", F.least("new", F.coalesce("component", "new")).alias("component"))
        after = written(after, "labels")
        labels = after.select("id", "component")
        if not after.filter("old <> component").limit(1).count():
            return labels
