"""A corpus pipeline of five stages: each reads what the one before it kept, as Parquet, and its decisions take effect.

All stages but the last return the columns of documents. Texts that the suffix-array stage shortens are cut in bytes; the remainders of characters
that a cut went through are left out, and n_chars is counted anew.

Edge cases: a null text counts as empty, is never rejected, keeps its row and comes out of the suffix-array stage as an empty text; null ids, langs and sources are passed on; of rows
that repeat id and text one stays, if the text has words; texts of any length are worked on whole; empty documents give an empty result; without labels nothing is toxic, and with an
empty benchmark nothing is contaminated; further columns of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, common, decontaminate, jaccard, substrings, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs.select(*COLUMNS), toxicity.default_chain(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # only bytes at cuts can be no UTF-8; U+FFFD that the document held are not touched
    out = substrings.dedup(docs.select(*COLUMNS), keep=("lang", "source"), decode=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, bpe.default_vocabulary(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: A trained model and byte cuts are not for SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = stage(spark, docs, sf_dir)
        docs = after if name == STAGES[-1][0] else common.written(after, f"stage-{name}")
    return docs
