"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import written


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v) with u > v.

    The minima are written before they are joined back, so both sides of each
    join are plain exchanges and a hub's edges can be split over tasks."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
    down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
    small = (large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(down.select("u", F.col("m").alias("v"))))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b): the smallest
    vertex it can reach.  Each step's minima are partial aggregates, so a
    vertex with very many neighbours costs one row per task; steps grow with
    the logarithm of the longest chain, and each is written out."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"),
                  F.expr("bit_xor(xxhash64(v, u, 1))").alias("y")).first()
        if r["n"] == 0 or tuple(r) == mark:
            break
        mark = tuple(r)
        e = written(_stars(e), "stars")
    return (e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()))
