"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b), both long; a component is named by its least node.

    Alternating large and small stars: each node hands its neighbours on to the least node it
    knows of, until every component is one star. Edges never multiply, rounds grow with the
    logarithm of the size, and every round is written, so that a lost executor costs one round;
    the rounds before it are deleted.
    """
    # u > v in every edge
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = materialize(e, name), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = now
        # written, so that the join's two sides are plain shuffles and a node of many edges can be split
        lower = materialize(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), name)
        large = e.join(lower, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, F.col("u") == F.col("n")).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        old, e = e, materialize(small.filter("u <> v").distinct(), name)
        discard(old, lower, large)
