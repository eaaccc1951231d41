"""Connected components as joins: every vertex hangs under its smallest neighbour, trees are flattened, and edges are contracted.

A round leaves at most half of each component's vertices, so rounds grow with the logarithm of the component; each is cut by a written
table. No neighbour list is gathered anywhere: the only aggregate is a minimum, which combines before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long): the smallest node reachable. Nulls and loops are no edges."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        while True:  # hang each node under its parent's parent until all hang under roots
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            if parent.join(above, "up").where("top <> up").isEmpty():
                break
            parent = written(parent.join(above, "up").select("node", F.col("top").alias("up")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            labels = written(labels.join(parent.withColumnRenamed("node", "component"), "component", "left")
                             .select("node", F.coalesce("up", "component").alias("component")), "labels")
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = written(edges.join(left, "a").join(right, "b").where("x <> y")
                        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
