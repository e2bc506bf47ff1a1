"""Feeds that are read page by page, over captured submissions: dual cursors with replay, early stops, bounded history pages, daily problems.

A page is the next `size` rows of an account from an inclusive instant on, as the provider would give it. All accounts take each step together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.graphs import cut

PAGE = 500
STEPS = 5
DAY = 86_400
BOOTSTRAP = 7 * DAY
STALLED = "Submission pagination stalled at a timestamp; history remains incomplete."


def page(cursors: DataFrame, feed: DataFrame, size: int = PAGE) -> DataFrame:
    """The next page of each account: the feed's columns and `start`. cursors: account, start; feed: account, id, epoch (seconds) and more."""
    place = F.row_number().over(Window.partitionBy("account").orderBy("epoch", "id"))
    return feed.join(cursors.select("account", "start"), "account").filter(F.col("epoch") >= F.col("start")).withColumn("_place", place).filter(F.col("_place") <= size).drop("_place")


def walked(cursors: DataFrame, feed: DataFrame, steps: int = STEPS, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Rows of up to `steps` pages from each cursor (account, start), and account, cursor, complete, stalled.

    The boundary is inclusive: the last second is read again, never skipped. A page that is not full ends the walk; a full page within one second stalls it.
    Each page is kept before the next is read, so no task holds more than one page's sort, and the walk ends when no account goes on.
    """
    at = cut(cursors.select("account", "start", F.lit(False).alias("complete"), F.lit(False).alias("stalled")))
    rows = None
    for _ in range(steps):
        going = at.filter("NOT complete AND NOT stalled")
        if rows is not None and not going.limit(1).count():
            break
        got = cut(page(going, feed, size))
        rows = got.drop("start") if rows is None else rows.unionByName(got.drop("start"))
        seen = got.groupBy("account").agg(F.count("*").alias("n"), F.max("epoch").alias("last"))
        moved = at.join(seen, "account", "left")
        active = ~F.col("complete") & ~F.col("stalled")
        full = F.coalesce(F.col("n") >= size, F.lit(False))
        last = F.greatest("start", F.coalesce("last", F.col("start")))
        at = cut(moved.select("account", F.when(active, last).otherwise(F.col("start")).alias("start"), F.when(active, ~full).otherwise(F.col("complete")).alias("complete"), F.when(active, full & (last == F.col("start"))).otherwise(F.col("stalled")).alias("stalled")))
    return rows.dropDuplicates(["account", "id"]), at.withColumnRenamed("start", "cursor")


def synced(state: DataFrame, feed: DataFrame, now: int, steps: int = STEPS, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Accepted records (account, id, key, epoch) and the state after one sync of every account.

    state: account, cursor (history), recent_cursor, history_complete, recent_complete; null cursors begin at 0 and a week ago. Recent activity
    comes first and replays a day, for rows that were indexed late; then history goes on where it was. feed: account, id, epoch, result, key.
    """
    replay = F.when(F.coalesce("recent_complete", F.lit(True)), DAY).otherwise(0)
    start = F.greatest(F.lit(0), F.coalesce("recent_cursor", F.lit(max(0, now - BOOTSTRAP))) - F.when(F.col("recent_cursor").isNull(), F.lit(DAY)).otherwise(replay))
    sound = feed.filter((F.col("id") > 0) & (F.col("epoch") <= now + 300))
    recent, after = walked(state.select("account", start.alias("start")), sound, steps, size)
    open_ = state.filter(~F.coalesce("history_complete", F.lit(False)))
    older, history = walked(open_.select("account", F.coalesce("cursor", F.lit(0).cast("long")).alias("start")), sound, steps, size)
    records = recent.unionByName(older).filter("result = 'AC'").dropDuplicates(["account", "id"]).select("account", "id", "key", "epoch")
    both = state.select("account", F.col("cursor").alias("_c"), F.coalesce("history_complete", F.lit(False)).alias("_h")).join(after.select("account", F.col("cursor").alias("_r"), F.col("complete").alias("_rc"), F.col("stalled").alias("_rs")), "account").join(history.select("account", F.col("cursor").alias("_n"), F.col("complete").alias("_nc"), F.col("stalled").alias("_ns")), "account", "left")
    new = both.select(
        "account", F.coalesce("_n", "_c").alias("cursor"), F.when(F.col("_rc"), F.greatest("_r", F.lit(now - DAY))).otherwise(F.col("_r")).alias("recent_cursor"), (F.col("_h") | F.coalesce("_nc", F.lit(False))).alias("history_complete"),
        F.col("_rc").alias("recent_complete"), F.when(F.col("_rs") | F.coalesce("_ns", F.lit(False)), STALLED).alias("warning"),
    )
    return records, new


def newest_pages(pages: DataFrame, known: DataFrame, size: int = 1000, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows of a feed that is served newest first, and account, pages, complete: reading stops after a page that isn't full, or one that reaches the last known id, or `most` pages.

    pages: account, page (from 0), id and more; known: account, latest (the greatest id of earlier syncs), whole (whether these were complete).
    """
    each = pages.filter(F.col("page") < most).groupBy("account", "page").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    marked = each.join(known, "account", "left").withColumn("short", F.col("n") < size).withColumn("met", F.coalesce(F.col("low") <= F.col("latest"), F.lit(False)))
    end = marked.groupBy("account").agg(F.coalesce(F.min(F.when(F.col("short") | F.col("met"), F.col("page"))), F.max("page")).alias("last"))
    told = marked.join(end, "account").filter("page = last").select("account", (F.col("last") + 1).cast("long").alias("pages"), (F.col("short") | (F.col("met") & F.coalesce("whole", F.lit(False)))).alias("complete"))
    rows = pages.join(end, "account").filter("page <= last").drop("last").dropDuplicates(["account", "id"])
    return rows, told


def history_pages(jobs: DataFrame, feed: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the next bounded page of each import job, and account, offset, complete. jobs: account, handle, offset; feed: account, pos (from 0), author, id and more.

    The job fails where a row is another author's, or where a page that has more behind it is empty.
    """
    own = feed.join(jobs.select("account", "handle", "offset"), "account").filter(F.col("pos") >= F.col("offset"))
    mine = F.lower("author") == F.lower("handle")
    rows = own.filter(F.col("pos") < F.col("offset") + size).filter(F.when(F.coalesce(mine, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit("Submission account did not match.")).cast("boolean")))
    counts = own.groupBy("account").agg(F.count_if(F.col("pos") < F.col("offset") + size).alias("n"), F.count("*").alias("rest"))
    after = jobs.select("account", "offset").join(counts, "account", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rest", F.coalesce("rest", F.lit(0)))
    stalled = (F.col("n") == 0) & (F.col("rest") > 0)
    after = after.filter(F.when(~stalled, F.lit(True)).otherwise(F.raise_error(F.lit("History pagination stalled.")).cast("boolean")))
    return rows.drop("handle", "offset"), after.select("account", (F.col("offset") + F.col("n")).alias("offset"), (F.col("n") < size).alias("complete"))


def daily_problems(captured: DataFrame, today: Column) -> DataFrame:
    """platform, day, url of the captured daily problems (platform, day, url) that are today's and on the platform's own pages."""
    # Where the daily problems of the platforms are.
    places = {"leetcode": r"^https://leetcode\.com/problems/[^/]+/", "geeksforgeeks": r"^https://www\.geeksforgeeks\.org/problems/[a-zA-Z0-9_-]+/1/?$"}
    sound = F.lit(False)
    for platform, pattern in places.items():
        sound = F.when(F.col("platform") == platform, F.col("url").rlike(pattern)).otherwise(sound)
    return captured.filter((F.col("day") == today) & sound).select("platform", "day", "url")


def yearly(saved: DataFrame, years: DataFrame, keys: tuple[str, ...] = ("account", "year")) -> DataFrame:
    """A calendar kept by year: the years that came replace the saved ones whole, the others stay."""
    return saved.join(years.select(*keys).distinct(), list(keys), "left_anti").select(saved.columns).unionByName(years.select(saved.columns))


def replace_years(years: DataFrame, folder: str, keys: tuple[str, ...] = ("account", "year")) -> None:
    """Put the years that came (account, year and more) into a calendar that is kept in a folder, partitioned by year. Only partitions of these years are written, by dynamic overwrite; in them the rows
    of other accounts stay, as do years that did not come, for example because their request failed."""
    spark, new = years.sparkSession, cut(years)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = [r.year for r in new.select("year").distinct().collect()]  # a partition each: few
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        saved = spark.read.schema(new.schema).parquet(folder).filter(F.col("year").isin(there))
        new = yearly(saved, new, keys)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(folder)


def profiles(raw: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Captured profile documents (account, body) read by a schema; the job fails for one that lacks a required field. Columns of the schema follow account."""
    read = raw.select("account", F.from_json("body", schema).alias("p"))
    for field in required:
        read = read.filter(F.when(F.col(f"p.{field}").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"profile without {field}: "), F.col("account").cast("string"))).cast("boolean")))
    return read.select("account", "p.*")


def embedded(html: Column, marker: str) -> Column:
    """The JSON texts that a page carries in script chunks: calls of `marker` with a number and a quoted string, unescaped and joined, cut into lines."""
    chunks = F.regexp_extract_all(html, F.lit(marker + r'\(\[\d+,\s*("(?:[^"\\]|\\.)*")\]\)'), F.lit(1))
    joined = F.array_join(F.transform(chunks, lambda c: F.coalesce(F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0)), F.lit(""))), "")
    return F.split(joined, "\n")


def field(lines: Column, name: str) -> Column:
    """The first number under a name, at any depth, in JSON lines."""
    hits = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(rf'"{name}"\s*:\s*(-?\d+)'), F.lit(1))))
    return F.get(hits, F.lit(0)).cast("long")


def replayed(reads: list[DataFrame], ids: tuple[str, ...]) -> DataFrame:
    """Overlapping reads of one feed put together: a row that was read again is one row. The streaming form is streaming.state.replayed."""
    out = reads[0]
    for more in reads[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(list(ids))
