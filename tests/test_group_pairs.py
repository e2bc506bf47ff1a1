from pyspark.sql import functions as F

from tallyspark.operators import accounts, catalog, similarity


def test_pairs_of_one_large_group_are_made_by_several_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with groups that are too large to send
    groups = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 4990, "a").when(F.col("id") < 4998, "b").when(F.col("id") < 4999, "c").alias("grp"))
    pairs = catalog.grouped_pairs(groups)
    made = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(made) == 4990 * 4989 // 2 + 8 * 7 // 2
    assert max(made) < 0.75 * sum(made)
    small = {tuple(r) for r in catalog.grouped_pairs(groups.filter("id >= 4985")).collect()}
    ids = [str(i) for i in range(4985, 5000)]
    assert small == {(a, b) for a in ids for b in ids if a < b and (b < "4990" or a >= "4990" and b < "4998")}


def test_pairs_across_two_tables_are_made_by_several_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    versions = spark.range(600).select(F.format_string("v%d", "id").alias("id"), F.when(F.col("id") < 590, "q").when(F.col("id") < 595, "r").alias("question_id"), F.when(F.col("id") % 3 == 0, "sorted").alias("contract"))
    asked = spark.range(0, 600, 2).select(F.format_string("v%d", "id").alias("asked_id"))
    none = versions.limit(0)
    got = accounts.matches(versions, asked, none.select("question_id", F.col("id").alias("other_id")), none.select(F.col("id").alias("asked_id"), "question_id", F.lit(0.0).alias("score")), task_rows=20_000)
    made = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    pairs = {(r.asked_id, r.version): r.relationship for r in got.collect()}
    few = {(r.l.asked_id, r.r.id) for r in similarity.pairs_across(asked.limit(3).withColumn("k", F.lit(1)), versions.limit(4).withColumn("k", F.lit(1)), "k", 4).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    key = lambda i: "q" if i < 590 else "r" if i < 595 else None
    want = {(f"v{i}", f"v{j}"): "equivalent" if (i % 3 == 0) == (j % 3 == 0) else "platform-variant" for i in range(0, 600, 2) for j in range(600) if i != j and key(i) is not None and key(i) == key(j)}
    assert pairs == want and len(few) == 12
    assert max(made) < 0.5 * sum(made)
