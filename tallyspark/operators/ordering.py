"""Numbering and cutting of total orders without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.graphs import cut


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """The rows with their places (long, from 1) in an order that ties nowhere.

    Rows are sorted by range, each partition counts its own, and a partition's rows are shifted by how many lie before it. The sorted rows
    are checkpointed, as two passes use them; only a count for each partition is gathered.
    """
    placed = cut(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(counts.select("__part", before.alias("__before")))  # a row for each partition
    return placed.withColumn("__part", part).join(shifts, "__part").withColumn(name, F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__place", "__before")


def first(df: DataFrame, order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of an order, numbered. Every partition keeps its own n only."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
