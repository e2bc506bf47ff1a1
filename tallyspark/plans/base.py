"""A small registry: queries by inventory ID, and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.readers import spread


#: Tables of long texts, whose functions cost far more than moving their rows.
TEXTS = ["documents", "pages"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; its zoneless timestamps are instants in the session's zone, UTC."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in TEXTS:
        df = spread(df)
    local = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register a function of a table reader: table(name) gives a driver table."""

        def keep(run):
            self.queries[name] = lambda spark, sf_dir, run=run: run(lambda table: read(spark, sf_dir, table))
            self.queries[name].__doc__ = run.__doc__
            if sql is not None:
                self.sql[name] = sql
            return run

        return keep
