"""Build outputs: staged tables published together, and a manifest of hashes written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows two tables do not share, repeats counted."""
    rest = left.exceptAll(right).unionByName(right.exceptAll(left))
    return rest.agg(F.count("*").alias("differing"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file below a folder; hashing happens where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _moved(spark: SparkSession, stage: str, place: str) -> None:
    """Put a staged folder in the place of another. The old one is set aside first and deleted last, so that at every moment one of the two is whole, in its place or beside it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{place}.old-{uuid.uuid4().hex}"
    had = fs.exists(path(place))
    if had and not fs.rename(path(place), path(aside)):
        raise OSError(f"could not set {place} aside")
    if not fs.rename(path(stage), path(place)):
        if had:
            fs.rename(path(aside), path(place))
        raise OSError(f"could not publish {place}")
    if had:
        fs.delete(path(aside), True)


def publish(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write all tables and their manifest to a staging folder, then put it in the place of the last build at once: readers see the old build or the new one, whole."""
    spark, stage = next(iter(tables.values())).sparkSession, f"{folder}.stage-{uuid.uuid4().hex}"
    hashes = None
    for name, df in tables.items():
        df.write.parquet(f"{stage}/{name}")
        own = file_hashes(spark, f"{stage}/{name}").filter("path LIKE '%.parquet'").withColumn("table", F.lit(name))
        hashes = own if hashes is None else hashes.unionByName(own)
    # files keep their names when their folder moves
    hashes.withColumn("path", F.concat_ws("/", F.lit(folder), "table", F.substring_index("path", "/", -1))).write.parquet(f"{stage}/manifest")
    _moved(spark, stage, folder)
    return spark.read.parquet(f"{folder}/manifest")


def report(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A Markdown report of small tables. A table of more than `most` rows is told by its count and its first rows in the order of its columns."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        rows, n = df.orderBy(*df.columns).limit(most).collect(), df.count()
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |" for row in rows]
        if n > most:
            lines += ["", f"{n} rows in all."]
    return "\n".join(lines) + "\n"


def json_sink(df: DataFrame, folder: str, order: list[str]) -> None:
    """Rows as JSON lines, sorted over all files, in place of what was there: staged first, then moved, so that a crash at any moment leaves the old rows or the new ones, whole."""
    stage = f"{folder}.stage-{uuid.uuid4().hex}"
    df.orderBy(*order).write.json(stage)
    _moved(df.sparkSession, stage, folder)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table that may not be there: missing, it is empty; any other fault fails as it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
