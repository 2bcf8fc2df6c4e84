"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import delete_folder, scratch_dir, settled, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an edge can reach.

    Each round, every node takes the smallest label among its own and its neighbours' (one partial
    aggregation), then the label of its label.  Rounds grow with the logarithm of a chain's length in
    the usual case; every round's result is written to the shared folder, so a lost executor costs one
    round at most, and only the result's table stays.
    """
    return settled(edges.sparkSession, "components", lambda: _labels(edges, a, b))


def _labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    spark = edges.sparkSession
    both = written(edges.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id <> other")
                   .union(edges.select(F.col(b).alias("id"), F.col(a).alias("other")).where("id <> other")).distinct(), "both-ends")
    held = scratch_dir(spark, "labels")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "", held)
    while True:
        near = (both.join(labels.withColumnRenamed("id", "other"), "other").select("id", "component")
                .union(labels).groupBy("id").agg(F.min("component").alias("near")))
        ends = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        # A label is itself a node with a label at most as large.
        jumped = near.join(ends, "near", "left").select("id", F.least("near", "far").alias("component"))
        path = scratch_dir(spark, "labels")
        fresh = written(jumped, "", path)
        changed = fresh.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        delete_folder(spark, held)
        labels, held = fresh, path
        if not changed:
            return labels
