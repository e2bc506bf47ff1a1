"""Calendar days, zones and texts about time. Clocks and zones are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDIA = "Asia/Kolkata"


def date_key(ts: Column, zone: Column | str) -> Column:
    """The local calendar day of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def shift_day(day: Column, n: Column | int) -> Column:
    return F.date_add(day, n)


def daily_day(platform: Column, ts: Column) -> Column:
    """The day of a platform's daily problem: UTC for one, India for the others."""
    return F.to_date(F.from_utc_timestamp(ts, F.when(platform == "leetcode", "UTC").otherwise(INDIA)))


def next_midnight(ts: Column, zone: str) -> Column:
    """The instant at which the next local day begins."""
    return F.to_utc_timestamp(F.date_add(date_key(ts, zone), 1).cast("timestamp"), zone)


def countdown(start: Column, end: Column, now: Column) -> Column:
    minutes = F.ceil((F.unix_millis(start) - F.unix_millis(now)) / 60000).cast("long")
    days, hours = F.floor(minutes / 1440).cast("long"), F.floor(minutes / 60).cast("long")
    return (
        F.when(now >= end, "Ended")
        .when(now >= start, "Live")
        .when(minutes >= 1440, F.format_string("in %dd %dh", days, F.floor((minutes % 1440) / 60).cast("long")))
        .when(minutes >= 60, F.format_string("in %dh %dm", hours, minutes % 60))
        .otherwise(F.format_string("in %dm", minutes))
    )


def time_ago(ts: Column, now: Column) -> Column:
    """How long ago, in minutes below an hour, hours below a day, then days."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 60000).cast("long")
    return F.when(ts.isNull(), "Not synced yet").when(minutes < 1, "Updated just now").when(minutes < 60, F.format_string("Updated %dm ago", minutes)).when(minutes < 1440, F.format_string("Updated %dh ago", F.floor(minutes / 60).cast("long"))).otherwise(F.format_string("Updated %dd ago", F.floor(minutes / 1440).cast("long")))


def india_time(text: Column) -> Column:
    """Local Indian time without an offset; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?$"), F.to_utc_timestamp(F.try_to_timestamp(text), INDIA))


def month_days(first: Column) -> Column:
    """The days of a month's calendar, Sunday first, in whole weeks."""
    lead, last = F.dayofweek(first) - 1, F.last_day(first)
    return F.sequence(F.date_sub(first, lead), F.date_add(last, 7 - F.dayofweek(last)))


def heat_level(count: Column) -> Column:
    return F.when(count <= 0, 0).when(count < 3, 1).when(count < 6, 2).when(count < 10, 3).otherwise(4)


def chart_scale(ts: Column, value: Column) -> list[Column]:
    """Aggregates of a chart: its first and last instant in milliseconds, and its top, the next hundred above the greatest value, 100 at least."""
    top = F.greatest(F.lit(100), F.ceil(F.greatest(F.lit(0.0), F.max(value)) / 100) * 100).cast("long")
    return [F.unix_millis(F.min(ts)).alias("first_ms"), F.unix_millis(F.max(ts)).alias("last_ms"), top.alias("top")]


def reminder_key(contest: Column, start: Column, minutes: Column) -> Column:
    """The name of a contest's alarm: it changes when the contest is moved."""
    return F.concat_ws(":", F.lit("contest"), contest.cast("string"), F.unix_millis(start).cast("string"), minutes.cast("string"))


def daily_key(platform: Column, handle: Column) -> Column:
    """Where an account's daily status is kept; handles in any case are one."""
    return F.concat_ws(":", F.lit("done"), platform, F.lower(handle))
