"""Contest schedules: normalizing rows, retention, merging refreshes, reminders, calendar cells. A contest runs from start up to, not including, end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where each platform's contests live.
URLS = {"codechef": "https://www.codechef.com/", "atcoder": "https://atcoder.jp/contests/", "geeksforgeeks": "https://www.geeksforgeeks.org/contest/", "code360": "https://www.naukri.com/code360/contests/", "leetcode": "https://leetcode.com/contest/", "codeforces": "https://codeforces.com/contest/"}
DAYS_14 = 14 * 86_400


def normalize(rows: DataFrame, platform: str) -> DataFrame:
    """rows (slug, title, start_s, end_s, pos) as contests: sound slugs, titles and durations up to 14 days; the last row of a slug wins."""
    long = F.col("end_s") - F.col("start_s")
    good = F.col("slug").rlike("^[a-zA-Z0-9_-]{1,150}$") & (F.trim("title") != "") & (F.col("start_s") > 0) & (long > 0) & (long <= DAYS_14)
    last = rows.filter(good).withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("pos")))).filter("r = 1")
    return last.select(F.concat(F.lit(f"{platform}-"), "slug").alias("id"), F.lit(platform).alias("platform"), F.substring(F.trim("title"), 1, 150).alias("title"), F.timestamp_seconds("start_s").alias("start"), F.timestamp_seconds("end_s").alias("end"), F.concat(F.lit(URLS[platform]), "slug").alias("url"))


def active(contests: DataFrame, now: Column) -> DataFrame:
    return contests.filter(F.col("end") > now)


def retained(contests: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return contests.filter((F.col("end") > F.col("start")) & (F.col("end") >= now - F.make_dt_interval(F.lit(days))) & F.col("url").startswith("https://"))


def refresh(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Ended contests stay; upcoming ones are replaced, so that cancelled ones vanish; of equal ids the new row wins."""
    ended = old.filter(F.col("end") <= now).join(new.select("id"), "id", "left_anti")
    return ended.unionByName(new)


def fresh(sources: DataFrame, now: Column) -> DataFrame:
    ok = F.col("updated_at").isNotNull() & ((F.unix_micros(now) - F.unix_micros("updated_at")) <= 6 * 3600 * 1_000_000) & F.col("error").isNull() & ~F.coalesce("needs_access", F.lit(False))
    return sources.filter(ok)


def reminders(contests: DataFrame, sent: DataFrame, now: Column, minutes: tuple[int, ...] = (60, 10)) -> DataFrame:
    """name, due of reminders still to come that were not sent. Each contest makes a fixed number of them."""
    each = active(contests, now).withColumn("minutes", F.explode(F.array(*map(F.lit, minutes))))
    due = F.timestamp_micros(F.unix_micros("start") - F.col("minutes").cast("long") * 60_000_000)
    name = F.concat_ws(":", F.lit("contest"), F.col("id").cast("string"), F.unix_millis("start").cast("string"), F.col("minutes").cast("string"))
    return each.select("id", "minutes", name.alias("name"), due.alias("due")).filter(F.col("due") > now).join(sent.select("name"), "name", "left_anti")


def deliverable(planned: DataFrame, now: Column, grace_minutes: int = 5) -> DataFrame:
    """Reminders whose time has come, within the grace after it."""
    return planned.filter((F.col("due") <= now) & (F.unix_micros(now) <= F.unix_micros("due") + F.lit(grace_minutes * 60_000_000).cast("long")))


def calendar_cells(contests: DataFrame, zone: str, most: int = 3) -> DataFrame:
    """The first `most` contests of each local day, and how many more there are."""
    w = Window.partitionBy("day")
    on = contests.withColumn("day", F.to_date(F.from_utc_timestamp("start", zone)))
    return on.withColumn("place", F.row_number().over(w.orderBy("start", "id"))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0))).filter(F.col("place") <= most)


def next_contest(contests: DataFrame, now: Column) -> DataFrame:
    return contests.filter(F.col("start") > now).agg(F.min_by("id", F.struct("start", "id")).alias("id"), F.greatest(F.count("*") - 1, F.lit(0)).alias("remaining"))


def connected(contests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contests of the platforms that have an account. Platforms are a handful, accounts are not broadcast before they are made distinct."""
    return contests.join(accounts.select("platform").distinct(), "platform", "left_semi")
