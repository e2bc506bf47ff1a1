from types import SimpleNamespace

from tallyspark.plans import document_queries, source_queries
from tallyspark.sources import feeds, profiles


def test_customers_of_one_row_group_are_dealt_out_before_costly_columns(spark, monkeypatch, tmp_path):
    spark.range(1, 101, 1, 1).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    held = []
    monkeypatch.setattr(feeds, "history_page", lambda rows, now: held.append(rows) or rows.selectExpr("link AS key", "title AS ts"))
    monkeypatch.setattr(profiles, "graph_profiles", lambda answers, older, year: held.extend([answers, older]) or SimpleNamespace(calendar=answers))
    source_queries.R.queries["s14_history_page"](spark, str(tmp_path))
    document_queries.R.queries["s07_profile_days"](spark, str(tmp_path))
    for df, costly in zip(held, ("link", "body", "body")):
        work = df.filter(f"{costly} <> ''")
        assert work.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and work.count() == 100
        assert "Exchange" not in work._jdf.queryExecution().executedPlan().toString()  # a filter can't take the work below it
