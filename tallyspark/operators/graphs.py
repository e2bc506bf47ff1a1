"""Graphs as edge tables: components and chains, by joins and aggregations only. Every step is checkpointed, so no plan refers to more than the step before it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder that spark.checkpoint.dir names, which all executors share; only a local master may do without that setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir is not set: steps need a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tallyspark-")
        context.setCheckpointDir(base)
    return df.checkpoint()


def _distinct(df: DataFrame) -> DataFrame:
    return df.filter("u <> v").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """k, m: each vertex with the least of itself and its neighbours. edges: u, v."""
    return edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """vertex, component: every vertex of an edge with the least vertex that it is connected to.

    Large and small stars alternate (Kiveris et al., 2014): neighbours above a vertex are linked with the least neighbour, then those below it are, until only stars are left; that takes
    some log(n)^2 steps at most, a chain of n vertices about log(n). A hub's edges are joined with one row, which adaptive execution can split; they are never gathered.
    """
    now, mark = cut(_distinct(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")))), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _distinct(both.join(_least(both), F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        near = large.join(_least(large), F.col("u") == F.col("k"))
        now = cut(_distinct(near.select("u", F.col("m").alias("v")).unionByName(near.select("v", F.col("m").alias("w")).toDF("u", "v"))))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def chain_ends(links: DataFrame, source: str, target: str) -> DataFrame:
    """source, target: every source with the end of its chain. A source has one target.

    Chains are followed by doubling: after k steps a row has gone 2^k links, or to its end. So n links are followed after log2(n) steps, and whatever moves then is on a cycle, which fails.
    """
    now = cut(links.select(F.col(source).alias("a"), F.col(target).alias("b"), F.lit(True).alias("moved")))
    n, reach = now.count(), 1
    while now.filter("moved").limit(1).count():
        if reach >= 2 * n:  # half of it was followed before the last step
            raise ValueError(f"cycle of links at {now.filter('moved').agg(F.min('a')).first()[0]}")
        step = now.select(F.col("a").alias("k"), F.col("b").alias("next"))
        now = cut(now.join(step, F.col("b") == F.col("k"), "left").select("a", F.coalesce("next", "b").alias("b"), F.col("next").isNotNull().alias("moved")))
        reach *= 2
    return now.select(F.col("a").alias(source), F.col("b").alias(target))
