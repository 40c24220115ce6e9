"""Connected components of an edge table by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node around it."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them."""
    low = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    tied = e.join(low, F.col("b") == F.col("u"))
    return tied.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Edges without direction, repeated ones and loops are fine; edges with a null end are left out. Each round is
    written to the shared folder; rounds grow with the logarithm of the longest chain. Nodes meet only in
    min-aggregates and joins, so a node with very many edges is pre-aggregated or split by Spark."""
    e = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    state = None
    while True:
        e = cut_lineage(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum("a")).first())
        if now == state or not now[0]:
            break
        state = now
    pairs = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component")).distinct()
