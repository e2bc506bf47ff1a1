"""Readers of captured inputs: bundled corpora, organization snapshots, solved lists, paged feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("title", T.StringType()), ("url", T.StringType()), ("difficulty", T.StringType()), ("isPremium", T.BooleanType()), ("topics", T.ArrayType(T.StringType())), ("description", T.StringType()), ("constraints", T.StringType()))])
RECORD = T.StructType([T.StructField(n, t) for n, t in (("platform", T.StringType()), ("id", T.StringType()), ("key", T.StringType()), ("title", T.StringType()), ("url", T.StringType()), ("ts", T.TimestampType()))])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores, if it comes in fewer: a file of one row group is one task, however many cores wait. Tables that are read in more parts, as all large ones are, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Problems of all platforms, one JSON array a file; a missing file is an empty corpus."""
    out = spark.createDataFrame([], PROBLEM).withColumn("platform", F.lit(""))
    for platform, path in paths.items():
        if exists(spark, path):
            out = out.unionByName(spark.read.schema(PROBLEM).json(path, multiLine=True).withColumn("platform", F.lit(platform)))
    return out


def company_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """company, window, slug, frequency of one CSV an organization and window (folder/company/window.csv); percent signs go, values beyond 0..100 fail the job."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(folder, header=True)
    path = F.col("_metadata.file_path")
    f = F.rtrim(F.trim("Frequency"), F.lit("%")).cast("double")
    sound = F.when(f.between(0, 100), f).otherwise(F.raise_error(F.concat(F.lit("invalid frequency: "), F.coalesce("Frequency", F.lit("null")))))
    return rows.select(F.regexp_extract(path, r"/([^/]+)/[^/]+\.csv$", 1).alias("company"), F.regexp_extract(path, r"/([^/]+)\.csv$", 1).alias("window"), F.regexp_extract("URL", "/problems/([^/]+)", 1).alias("slug"), sound.alias("frequency"))


def solved_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A solved list with quotes, doubled quotes and line breaks in fields; blanks around fields go, malformed files fail."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST").dropna("all")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("url")).filter("url <> ''")


def pages(spark: SparkSession, folder: str, schema: T.StructType = RECORD, per_batch: int = 5) -> DataFrame:
    """A stream of captured feed pages, at most `per_batch` of them a micro-batch; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)
