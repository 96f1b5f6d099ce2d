"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Smallest-label propagation with pointer jumping; every round is written, so
    the plan does not grow and a lost executor re-reads files.
    """
    both = stash(edges.select(F.col(u).alias("a"), F.col(v).alias("b"))
                 .unionByName(edges.select(F.col(v).alias("a"), F.col(u).alias("b"))).where("a <> b").distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
                   .select(F.col("a").alias("node"), "label"), "labels")
    while True:
        heard = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard")))
        lower = labels.join(heard, labels.node == heard.a).select("node", "label", F.least("label", "heard").alias("new"))
        step = stash(lower, "labels")
        jump = step.select(F.col("node").alias("__at"), F.col("new").alias("__to"))
        moved = stash(step.join(jump, step.new == F.col("__at"), "left")
                      .select("node", "label", F.least("new", F.coalesce("__to", "new")).alias("new")), "labels")
        changed = moved.where("new <> label").count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
