"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.durable import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node.

    Each round takes the smallest label among neighbours and then the label of that label, so that
    chains shrink by halves. Labels are written to the checkpoint folder once a round, which both cuts
    the lineage and keeps the joins' inputs splittable where one node has very many edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = durable(pairs.union(pairs.select("v", "u")).distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).withColumnRenamed("u", "node")
    if both.isEmpty():
        return label.withColumnRenamed("l", "component")
    label = durable(label)
    while True:
        seen = both.join(label, both.v == label.node).select("u", "l", F.lit(None).cast(label.schema["l"].dataType).alias("old"))
        # A node's own label is in its last row, so that the round's change needs no join of its own.
        near = durable(seen.union(label.select("node", "l", "l")).groupBy("u").agg(F.min("l").alias("l"), F.max("old").alias("old")).withColumnRenamed("u", "node"))
        up = near.select(F.col("node").alias("l"), F.col("l").alias("far"))
        fresh = durable(near.join(up, "l", "left").select("node", F.coalesce("far", "l").alias("l"), "old"))
        changed = not fresh.filter("l <> old").isEmpty()
        label = fresh.select("node", "l")
        if not changed:
            return label.withColumnRenamed("l", "component")
