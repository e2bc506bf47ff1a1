"""Profiles from captured answers: totals, submission calendars, recent accepted records and contest histories, as tables. A profile without what it needs has a fault and nothing else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the first provider's answers are shaped, how many years of calendar are read, where problems are, and the faults.
ANSWER = """struct<errors: array<struct<message: string>>, data: struct<matchedUser: struct<username: string, profile: struct<ranking: bigint>, submitStatsGlobal: struct<acSubmissionNum: array<struct<difficulty: string, count: bigint>>>,
badges: array<struct<name: string>>, userCalendar: struct<activeYears: array<int>, submissionCalendar: string>>, recentAcSubmissionList: array<struct<id: string, title: string, titleSlug: string, timestamp: string>>,
userContestRanking: struct<rating: double>, userContestRankingHistory: array<struct<attended: boolean, rating: double, contest: struct<title: string, startTime: bigint>>>>>"""
YEARS = 3
PROBLEMS = "https://leetcode.com/problems/"
NOT_FOUND = "Profile not found. Check your handle."
UNAVAILABLE = "Profile unavailable."
#: The second provider's: totals by level.
TOTALS = "struct<data: struct<dsa_domain_data: struct<problem_count_data: struct<total_count: bigint, difficulty_data: array<struct<level: string, count: bigint>>>>>>"


@dataclass(frozen=True)
class Profiles:
    totals: DataFrame  # account, total, breakdown (map), rank, rating, badges, calendar_available, fault
    recent: DataFrame  # account, id, key, title, url, ts
    calendar: DataFrame  # account, day, n
    ratings: DataFrame  # account, ts, rating, title


def _days(text: Column) -> Column:
    """The entries (second, n) of a calendar that is itself written as JSON: counts above zero."""
    entries = F.map_entries(F.from_json(text, "map<string, bigint>"))
    sound = F.filter(entries, lambda e: F.coalesce((F.try_to_number(e["key"], F.lit("999999999999")) > 0) & (e["value"] > 0), F.lit(False)))
    return F.transform(sound, lambda e: F.struct(e["key"].cast("long").alias("second"), e["value"].alias("n")))


def graph_profiles(answers: DataFrame, older: DataFrame, this_year: int, signed_in: DataFrame | None = None) -> Profiles:
    """answers: account, body (the profile's answer); older: account, year, body (a calendar text) of earlier years, of which only active ones within YEARS count; signed_in: account, id, title, titleSlug, timestamp of records
    that the user's own tab told, which come after the public ones. Of records with one id the last stays; of a day's calendar entries the latest."""
    read = answers.select("account", F.from_json("body", ANSWER).alias("a"), F.try_parse_json("body").isNotNull().alias("json"))
    user, data = F.col("a.data.matchedUser"), "a.data"
    fault = F.when(F.size(F.coalesce("a.errors", F.array())) > 0, F.coalesce(F.get("a.errors", F.lit(0))["message"], F.lit(UNAVAILABLE))).when(user.isNull(), NOT_FOUND)
    read = read.withColumn("fault", F.when(~F.col("json"), UNAVAILABLE).otherwise(fault)).drop("json")
    sound = read.filter("fault IS NULL")
    levels = F.map_from_entries(F.transform(F.col(f"{data}.matchedUser.submitStatsGlobal.acSubmissionNum"), lambda x: F.struct(x["difficulty"], x["count"])))
    badges = F.coalesce(F.transform(user["badges"], lambda b: b["name"]), F.array().cast("array<string>"))
    figures = [F.coalesce(levels["All"], F.lit(0).cast("long")).alias("total"), levels.alias("breakdown"), user["profile"]["ranking"].alias("rank"), F.col(f"{data}.userContestRanking.rating").alias("rating"), badges.alias("badges"), user["userCalendar"]["submissionCalendar"].isNotNull().alias("calendar_available")]
    totals = read.select("account", *(F.when(F.col("fault").isNull(), c).alias(n) for c, n in zip(figures, ("total", "breakdown", "rank", "rating", "badges", "calendar_available"), strict=True)), "fault")

    fields = ["id", "title", "titleSlug", "timestamp"]
    recent = sound.select("account", F.posexplode(f"{data}.recentAcSubmissionList").alias("pos", "r")).select("account", "pos", *(F.col(f"r.{c}").alias(c) for c in fields))
    if signed_in is not None:
        own = signed_in.join(sound.select("account"), "account", "left_semi").select("account", (F.monotonically_increasing_id() + (1 << 40)).alias("pos"), *(F.col(c).cast("string").alias(c) for c in fields))
        recent = recent.withColumn("pos", F.col("pos").cast("long")).unionByName(own)
    stamp = F.col("timestamp").try_cast("long")
    whole = recent.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("titleSlug", F.lit("")) != "") & (stamp > 0))
    last = whole.groupBy("account", "id").agg(F.max_by(F.struct("title", "titleSlug", stamp.alias("s")), "pos").alias("r"))
    recent = last.select("account", "id", F.concat(F.lit("leetcode:"), "r.titleSlug").alias("key"), F.col("r.title").alias("title"), F.concat(F.lit(PROBLEMS), F.replace(F.url_encode("r.titleSlug"), F.lit("+"), F.lit("%20")), F.lit("/")).alias("url"), F.timestamp_seconds("r.s").alias("ts"))

    # an empty calendar is one without days; years that the account was not active in are not asked for
    active = sound.select("account", F.explode(user["userCalendar"]["activeYears"]).alias("year")).filter(F.col("year").between(this_year - YEARS + 1, this_year - 1)).distinct()
    now = sound.select("account", user["userCalendar"]["submissionCalendar"].alias("body"))
    before = older.join(active, ["account", "year"], "left_semi").select("account", "body")
    entries = now.unionByName(before).select("account", F.explode(_days(F.col("body"))).alias("e")).select("account", "e.*")
    calendar = entries.groupBy("account", F.to_date(F.timestamp_seconds("second")).alias("day")).agg(F.max_by("n", "second").alias("n"))

    history = sound.select("account", F.explode(f"{data}.userContestRankingHistory").alias("h")).filter("h.attended")
    ratings = history.select("account", F.timestamp_seconds("h.contest.startTime").alias("ts"), F.col("h.rating").alias("rating"), F.col("h.contest.title").alias("title"))
    return Profiles(totals, recent, calendar, ratings)


def level_profiles(answers: DataFrame) -> DataFrame:
    """account, total, breakdown (map by level), fault of the second provider's answers (account, body)."""
    counts = F.col("a.data.dsa_domain_data.problem_count_data")
    read = answers.select("account", F.from_json("body", TOTALS).alias("a")).withColumn("fault", F.when(F.coalesce(counts["total_count"].isNull(), F.lit(True)), UNAVAILABLE))
    levels = F.coalesce(counts["difficulty_data"], F.array().cast("array<struct<level:string,count:bigint>>"))
    breakdown = F.map_from_entries(F.transform(levels, lambda x: F.struct(x["level"], F.coalesce(x["count"], F.lit(0).cast("long")))))
    return read.select("account", counts["total_count"].alias("total"), F.when(F.col("fault").isNull(), breakdown).alias("breakdown"), "fault")
