"""Connected components of an edge table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("u <> v").distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """v long, c long: every vertex of an edge, with the least vertex that it is connected to. Hubs are joined, not gathered."""
    now = common.written(_pairs(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))), "stars")
    mark = None
    while True:  # the stars settle after log(n)^2 steps at most
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = _pairs(both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = common.written(_pairs(small), "stars")
        common.drop_written(now)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select("v", F.col("v").alias("c")).distinct())
