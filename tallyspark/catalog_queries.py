"""Registry of the queries of the practice-analytics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import account_queries, activity_queries, catalog_plans, directory_queries, document_queries, library_queries, similarity_queries, source_queries, text_queries
from tallyspark.plans.base import read

REGISTRIES = [activity_queries.R, text_queries.R, library_queries.R, catalog_plans.R, similarity_queries.R, directory_queries.R, source_queries.R, account_queries.R, document_queries.R]
QUERIES = {name: run for r in REGISTRIES for name, run in r.queries.items()}
SQL = {name: sql for r in REGISTRIES for name, sql in r.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate duplicates among documents, with scores."""
    return similarity_queries.flagship(lambda table: read(spark, sf_dir, table))
