"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs to rows (node, root): root is the component's smallest node.

    Nodes without an edge to another node do not occur; loops, nulls and repeated edges are
    ignored; no edges give no rows. Every step is a pre-aggregated minimum joined back to the
    edges, so a node with very many neighbours is split like any skewed join; the steps end when
    the edge set no longer changes (about the logarithm of the longest path).
    """
    current = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "edges")
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.unionByName(floor.withColumnRenamed("m", "b")).distinct(), "edges")
        discard(current)
        discard(large)
        current = nxt
        row = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(row):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = tuple(row)
