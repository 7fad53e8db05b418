"""Connected components of a distributed edge list by alternating large and small stars.

A round takes two steps. Large star: every vertex links its larger neighbours with the
least vertex among its neighbours and itself. Small star: every vertex links itself and
its smaller neighbours with the least of these. Neither changes what is connected, and
each component becomes a star around its least vertex after a number of rounds that
grows with the logarithm of its size. Minima are pre-aggregated in each task, every
round is one table written to the shared folder, and only an edge count and a checksum
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import Tables


def _large_star(edges: DataFrame) -> DataFrame:
    """edges(a > b) -> (a, b): each larger neighbour with the least of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges(a > b) -> (a, b): each vertex and its smaller neighbours with the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, component: the least vertex that each vertex with an edge reaches."""
    tables = Tables(edges.sparkSession)
    now = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            break
        state, before = seen, now
        now = tables.keep(_small_star(_large_star(before)))
        tables.drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
