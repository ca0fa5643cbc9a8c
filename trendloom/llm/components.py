"""Connected components by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` to ``node, comp``: the smallest node of each component.

    Every round takes the least label among neighbours, then the label's own
    label, so chains halve; a round is two shuffles of node-sized tables.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        up = step.select(F.col("node").alias("up"), F.col("new").alias("upper"))
        after = step.join(up, step.new == up.up).select("node", F.least("new", "upper").alias("comp"), "old")
        after = checkpointed(after)
        if after.filter("comp <> old").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
