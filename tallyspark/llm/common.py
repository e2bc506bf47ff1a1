"""Shared plumbing of the training-data operators: tables, the shared work folder, folds, Arrow columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Batches that Spark hands to Python workers are cut at so many bytes, as a worker holds a batch twice (as sent, and as it is worked on).
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch from its default to BATCH_BYTES; a limit that somebody has set is left alone."""
    if spark.conf.get(BATCH_CONF) == "67108864b":
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Without that setting only a local master has one: its own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tallyspark-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path, before = shared_path(spark, tag), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for a table on its way is not needed once the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyspark_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_tallyspark_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % F.lit(n)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; other columns, clashing names included, are dropped."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def labelled(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """picked (doc_id and more, once an id, few) with the text of each id: of documents that share an id the one with the least hash, so that no id brings more than one row."""
    rest = [c for c in picked.columns if c != "doc_id"]
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", *rest).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def utf8(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The joined bytes of a string or binary column without nulls, and the offsets of its values in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return b"", np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    first, last = int(off[0]), int(off[-1])  # of a slice, only its own bytes are copied
    return data.slice(first, last - first).to_pybytes() if data is not None else b"", off - first


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Hand memory that is free again back to the system: executors have little besides the JVM's heap, and a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20, every: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold at most `most` bytes, or one row. Free memory is released after `every` bytes, and at the end."""
    done = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            done += int(ends[stop - 1] - base)
            start = stop
            if done >= every:
                released()
                done = 0
    released()
