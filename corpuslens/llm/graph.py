"""Connected components on the executors: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b): the smallest id that can be reached.

    Every round writes its edge table to the shared folder, so lineage stays short; rounds grow with the logarithm of
    the largest component. Self-edges and nulls are ignored; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stage(spark, now, "edges", narrow=True)
    seen = _print(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = stage(spark, small, "edges", narrow=True)
        before, seen = seen, _print(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _print(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
