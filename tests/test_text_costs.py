import time

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import catalog


def seconds(run):
    def once():
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    return min(once() for _ in range(4))


def test_settled_texts_are_told_about_as_fast_as_by_one_range(spark):
    texts = spark.range(20).select(F.repeat(F.concat(F.lit("plain words of a text "), F.col("id").cast("string")), 10_000).alias("t")).cache()
    texts.count()
    plain, settled = (seconds(lambda p=p: texts.filter(F.col("t").rlike(p)).count()) for p in (r"[^\x{0}-\x{9F}]", text.UNSETTLED))
    texts.unpersist()
    assert settled < 3 * plain


def test_white_space_is_squeezed_and_single_spaces_stay(spark):
    blanks = [chr(p) for p in range(0x3001) if chr(p).isspace() and not 0x1C <= p <= 0x1F] + ["﻿"]
    runs = ["", " ", "  ", *blanks, *(f" {b}" for b in blanks), *(f"{b} " for b in blanks), *(f"{b}\t" for b in blanks), " \n \r\n"]
    texts = [f(r) for r in runs for f in (lambda r: f"a{r}b c{r}d", lambda r: f"{r}a{r}", lambda r: r)]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.squeeze(F.col("t")).alias("x")).collect()]
    assert got == [" ".join(t.replace("﻿", " ").split()) for t in texts]


def test_judging_looks_at_the_ends_of_statements(spark):
    ends = ["for", "Note:", "example :", "INPUT", "output \u0085", "...", "…", ". . .", "therefor", "x_for", "é for", "for\n", "for \r\n", "for\u2028", "for\u2028\u2028", "for" + " " * 60, "... " + "\t" * 60 + ":", "for :" + " " * 60, "", "."]
    texts = [f"{head}{end}" for head in ("", "a ", "word " * 14, "word " * 15, "one, two; three-four " * 9) for end in ends]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, description string")
    versions = df.select("id", "description", *(F.lit("x").alias(c) for c in ("fingerprint", "title_key", "title", "platform", "url")))
    plain = df.select("id", F.col("description").rlike(catalog.CUT_OFF).alias("want_cut"), ((F.length("description") < 80) | (F.regexp_count("description", F.lit(r"[\p{L}\p{N}]+")) < 15)).alias("want_thin"))
    rows = catalog.judged(versions).join(plain, "id").collect()
    assert len(rows) == len(texts) and all((r.cut_off, r.thin) == (r.want_cut, r.want_thin) for r in rows)
    assert {r.cut_off for r in rows} == {r.thin for r in rows} == {True, False}
    long = versions.limit(1).crossJoin(spark.range(20).select(F.repeat(F.concat(F.lit("plain words of a text "), F.col("id").cast("string")), 80_000).alias("long"))).withColumn("description", F.col("long")).cache()
    long.count()
    whole = seconds(lambda: long.filter(F.col("description").rlike(catalog.CUT_OFF)).count())
    judged = seconds(lambda: catalog.judged(long).agg(F.bool_or("cut_off"), F.bool_or("thin")).collect())
    long.unpersist()
    assert judged < 0.7 * whole
