"""Documents of any shape: JSON as VARIANT, walked level by level with lateral joins. Every level is checkpointed, so that plans don't grow with depth."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.graphs import cut


def kind(node: Column) -> Column:
    """What a variant is: OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null), else a number's type; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def at(node: Column, path: str) -> Column:
    """The variant at a path, null where there is none."""
    return F.try_variant_get(node, path, "variant")


def children(df: DataFrame, node: str) -> DataFrame:
    """df with pos, key (null in arrays) and value of each child of an object or array; other nodes have none."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(node).outer()))


def levels(df: DataFrame, key: str, node: str, most: int | None = None) -> Iterator[DataFrame]:
    """Tables of key, place (the positions on the way from the top), name (the key under which a node stands), node: the top first, then each level below it; at most `most` levels."""
    level = cut(df.select(key, F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("name"), F.col(node).alias("node")).filter("node IS NOT NULL"))
    n = 0
    while (most is None or n < most) and level.limit(1).count():
        yield level
        n += 1
        below = children(level.select(F.col(key), "place", "node"), "node")
        level = cut(below.select(key, F.concat("place", F.array("pos")).alias("place"), F.col("key").alias("name") if key != "key" else below["key"].alias("name"), F.col("value").alias("node")))


def found(df: DataFrame, key: str, node: str, wanted: Column) -> DataFrame:
    """key, place, node of all nodes, at any depth, that the condition on `node` holds for. Places sort as a reader meets the nodes: a parent before its children."""
    out = None
    for level in levels(df, key, node):
        hits = level.filter(wanted).select(key, "place", "node")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else df.select(key, F.array().cast("array<int>").alias("place"), F.col(node).alias("node")).limit(0)
