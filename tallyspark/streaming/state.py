"""Keyed, bounded, replay-safe state for incremental snapshots, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MERGED = T.StructType([T.StructField("platform", T.StringType()), T.StructField("key", T.StringType()), T.StructField("id", T.StringType()), T.StructField("ts", T.TimestampType())])


class SolvedState(StatefulProcessor):
    """For each platform, every solved key with its latest record; equal instants go to the record that came later. Updates are emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("key", T.StringType())])
        value = T.StructType([T.StructField("id", T.StringType()), T.StructField("ts", T.LongType())])
        self.solved = handle.getMapState("solved", key, value)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple[str, int]] = {}
        for pdf in rows:
            for k, i, ts in zip(pdf["key"], pdf["id"], pdf["ts"]):
                if k is None:
                    continue
                at = 0 if pd.isna(ts) else int(pd.Timestamp(ts).value // 1000)
                old = changed.get(k) or (tuple(self.solved.getValue((k,))) if self.solved.containsKey((k,)) else None)
                if old is None or at >= old[1]:
                    changed[k] = (i, at)
        for k, v in changed.items():
            self.solved.updateValue((k,), v)
        if changed:
            yield pd.DataFrame({"platform": key[0], "key": list(changed), "id": [v[0] for v in changed.values()], "ts": [pd.Timestamp(v[1], unit="us") if v[1] else pd.NaT for v in changed.values()]})

    def close(self) -> None:
        pass


class Throttled(StatefulProcessor):
    """Of each key's events, those at least `gap` seconds after the last one that passed; the first one passes. Within a batch events go in order of time."""

    def __init__(self, gap: float):
        self.gap = int(gap * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for at in sorted(int(pd.Timestamp(ts).value // 1000) for pdf in rows for ts in pdf["ts"]):
            if last is None or at - last >= self.gap:
                last = at
                passed.append(at)
        if passed:
            self.last.update((last,))
            yield pd.DataFrame({"key": key[0], "ts": [pd.Timestamp(x, unit="us") for x in passed]})

    def close(self) -> None:
        pass


def throttled(events: DataFrame, gap: float) -> DataFrame:
    """key, ts of the events that start a refresh: repeats within `gap` seconds of the last one are dropped, across batches too."""
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType())])
    return events.select("key", "ts").groupBy("key").transformWithStateInPandas(statefulProcessor=Throttled(gap), outputStructType=out, outputMode="Update", timeMode="None")


@contextmanager
def cancellable(spark: SparkSession, request: str) -> Iterator[None]:
    """Jobs started inside belong to a request and end when cancel() names it."""
    spark.sparkContext.addJobTag(request)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(request)


def cancel(spark: SparkSession, request: str) -> None:
    """Stop what a request still runs; requests that are over, or unknown, change nothing."""
    spark.sparkContext.cancelJobsWithTag(request)


def merge_stream(records: DataFrame) -> DataFrame:
    """Latest record of each (platform, key) as records arrive; needs the RocksDB state store."""
    return records.select("platform", "key", "id", "ts").groupBy("platform").transformWithStateInPandas(statefulProcessor=SolvedState(), outputStructType=MERGED, outputMode="Update", timeMode="None")


def replayed(records: DataFrame, overlap: str = "1 day", ids: tuple[str, ...] = ("platform", "id")) -> DataFrame:
    """A feed whose pages overlap: rows seen within the overlap are dropped by id, later ones are late."""
    return records.withWatermark("ts", overlap).dropDuplicatesWithinWatermark(list(ids))


def day_counts(records: DataFrame, zone: str, late: str = "1 day") -> DataFrame:
    """Distinct keys of each local day, as they come in."""
    days = records.withWatermark("ts", late).withColumn("day", F.to_date(F.from_utc_timestamp("ts", zone)))
    return days.dropDuplicatesWithinWatermark(["key", "day"]).groupBy("day").agg(F.count("*").alias("n"))


class Versions:
    """A table kept as whole versions below a folder; a version counts once its marker is there, so a lost job leaves the last one in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        if not self.fs.exists(self.path(self.folder)):
            return -1
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self.fs.exists(self.path(f"{self.folder}/{n}/_SUCCESS"))), default=-1)

    def read(self) -> DataFrame | None:
        n = self.latest()
        return None if n < 0 else self.spark.read.parquet(f"{self.folder}/v{n}")

    def upsert(self, batch: DataFrame, key: list[str], order: list[str], batch_id: int) -> None:
        """Rows of a micro-batch by key, the greatest order wins, the batch over equal ones. A batch that was already written is skipped on replay."""
        if batch_id <= self.latest():
            return
        old = self.read()
        rows = batch.withColumn("__new", F.lit(1))
        if old is not None:
            rows = old.withColumn("__new", F.lit(0)).unionByName(rows)
        rest = [c for c in batch.columns if c not in key]
        best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, "__new")).alias("x")).select(*key, "x.*")
        best.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")


def keep_upserted(stream: DataFrame, folder: str, checkpoint: str, key: list[str], order: list[str]):
    """One writer: each micro-batch makes the next version of the table."""
    state = Versions(stream.sparkSession, folder)
    return stream.writeStream.foreachBatch(lambda df, n: state.upsert(df, key, order, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
