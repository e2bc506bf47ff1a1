"""Activity analytics over accepted records: (platform, id, key, title, ts, day?, pending?) and accounts (platform, synced_at).

Records are counted on local days; a provider's own day, where given, wins over the instant. Clocks and zones are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.times import INDIA, date_key
from tallyspark.operators.graphs import cut
from tallyspark.operators.ordering import numbered


def record_day(zone: str) -> Column:
    return F.coalesce(F.col("day"), date_key(F.col("ts"), zone))


def overlay(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pending records since their account's last sync, which a provider's calendar can't have yet."""
    synced = records.join(accounts.select("platform", "synced_at"), "platform", "left")
    return synced.filter(F.coalesce("pending", F.lit(False)) & (F.col("ts") > F.coalesce("synced_at", F.lit(0).cast("timestamp"))))


def daily_activity(records: DataFrame, calendar: DataFrame, accounts: DataFrame, zone: str, by: tuple[str, ...] = ()) -> DataFrame:
    """day, n: provider calendars plus what is pending since the last sync; platforms without a calendar by their records."""
    with_calendar = calendar.select("platform").distinct()
    given = calendar.filter(F.col("day").isNotNull() & ~F.isnan(F.col("count").cast("double")) & (F.col("count") > 0)).select(*by, "day", F.col("count").cast("long").alias("n"))
    synced = records.join(accounts.select("platform", "synced_at"), "platform", "left")
    pending = overlay(records, accounts).join(with_calendar, "platform", "left_semi")
    plain = synced.join(with_calendar, "platform", "left_anti")
    counted = pending.unionByName(plain).withColumn("day", record_day(zone)).filter("day IS NOT NULL").select(*by, "day", F.lit(1).cast("long").alias("n"))
    return given.unionByName(counted).groupBy(*by, "day").agg(F.sum("n").alias("n"))


def streaks(counts: DataFrame, today: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """longest and current runs of days with n > 0 up to today; the current one may end yesterday. Islands have one value of day minus rank."""
    days = counts.filter((F.col("n") > 0) & (F.col("day") <= today)).select(*by, "day").distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    runs = days.withColumn("island", F.date_sub("day", rank)).groupBy(*by, "island").agg(F.count("*").alias("run"), F.max("day").alias("end"))
    current = F.max(F.when(F.col("end") >= F.date_sub(today, 1), F.col("run")))
    return runs.groupBy(*by).agg(F.coalesce(current, F.lit(0)).cast("long").alias("current"), F.coalesce(F.max("run"), F.lit(0)).cast("long").alias("longest"))


def accepted_today(records: DataFrame, today: Column, zone: str) -> DataFrame:
    return records.filter(record_day(zone) == today).agg(F.countDistinct("key").alias("n"))


def practice_today(records: DataFrame, calendar: DataFrame, now: Column, zone: str, counted: str = "tuf") -> DataFrame:
    """Distinct problems of the day, plus the India-day calendar count of the platform that reports only counts."""
    own = accepted_today(records.filter(F.col("platform") != counted), date_key(now, zone), zone)
    extra = calendar.filter((F.col("platform") == counted) & (F.col("day") == date_key(now, INDIA)) & (F.col("count") > 0)).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("extra"))
    return own.crossJoin(extra).select((F.col("n") + F.col("extra")).alias("n"))


def overview(snapshots: DataFrame) -> DataFrame:
    """One row over accounts with a snapshot (total_solved, lower_bound, notice): null sums without any."""
    return snapshots.agg(F.sum(F.coalesce("total_solved", F.lit(0))).alias("total"), F.coalesce(F.bool_or("lower_bound"), F.lit(False)).alias("lower_bound"), F.array_join(F.array_sort(F.collect_list("notice")), " ").alias("notice"))


def done_questions(recent: DataFrame, solved: DataFrame, query: str = "", platform: str | None = None, first: Column | None = None, last: Column | None = None, oldest: bool = False, zone: str = "UTC") -> DataFrame:
    """One row a key: the latest dated record, else the undated solved one; then terms in the title, platform and inclusive local days. rn orders, total counts before filters."""
    latest = recent.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), "id"))).filter("r = 1").drop("r")
    extra = solved.join(latest.select("key"), "key", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_last("ts"), "id"))).filter("r = 1").drop("r")
    unique = cut(latest.unionByName(extra.select(latest.columns)))  # counted, filtered and sorted: three passes
    total = unique.agg(F.count("*").alias("total"))
    out, day = unique, F.coalesce(F.col("day"), date_key(F.col("ts"), zone))
    if platform:
        out = out.filter(F.col("platform") == platform)
    for term in query.lower().split():
        out = out.filter(F.lower("title").contains(term))
    if first is not None:
        out = out.filter(F.coalesce(day >= first, F.lit(False)))
    if last is not None:
        out = out.filter(F.coalesce(day <= last, F.lit(False)))
    order = [F.asc_nulls_first("ts"), F.desc("key")] if oldest else [F.desc_nulls_last("ts"), F.asc("key")]
    return numbered(out.crossJoin(F.broadcast(total)), order)


def rating_series(points: DataFrame, accounts: DataFrame, year: int, zone: str) -> DataFrame:
    """platform, ts, rating in a local year, numbered by time. A platform without any sound point gets its current value at its last sync."""
    sound = F.col("rating").isNotNull() & ~F.isnan("rating") & (F.col("ts") > F.lit(0).cast("timestamp"))
    kept = points.filter(sound).select("platform", "ts", "rating")
    current = accounts.join(kept.select("platform").distinct(), "platform", "left_anti").select("platform", F.col("synced_at").alias("ts"), F.col("current").alias("rating")).filter(sound)
    own = kept.unionByName(current).filter(F.year(F.from_utc_timestamp("ts", zone)) == year)
    return own.withColumn("n", F.row_number().over(Window.partitionBy("platform").orderBy("ts", "rating")))


def score_history(observed: DataFrame, keep: int = 180, by: tuple[str, ...] = ("platform",)) -> DataFrame:
    """The last observation of each UTC day, and of these the newest `keep` days. Null scores are none, zero is one."""
    day = F.to_date("ts")
    last = observed.filter("score IS NOT NULL").withColumn("day", day).withColumn("r", F.row_number().over(Window.partitionBy(*by, "day").orderBy(F.desc("ts"), F.desc("score")))).filter("r = 1")
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("day")))
    return last.withColumn("r", newest).filter(F.col("r") <= keep).drop("r")


def newest(df: DataFrame, keep: int, order: list, by: tuple[str, ...]) -> DataFrame:
    """The newest `keep` rows of each key, and whether any were cut (clipped)."""
    w = Window.partitionBy(*by)
    return df.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("clipped", F.count("*").over(w) > keep).filter(F.col("r") <= keep)


def heatmap(counts: DataFrame, year: int, today: Column) -> DataFrame:
    """Every day of a year with its count and level; days after today count nothing."""
    from tallyspark.functions.times import heat_level

    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))).alias("day"))
    return spine.join(F.broadcast(counts.filter((F.year("day") == year) & (F.col("day") <= today)).select("day", "n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("level", heat_level(F.col("n")))


def last_rating(points: DataFrame) -> DataFrame:
    return points.groupBy("platform").agg(F.max_by("rating", "ts").alias("rating"))


def recent_keys(records: DataFrame, n: int = 12) -> DataFrame:
    """The newest n distinct keys."""
    return records.groupBy("key").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "key").limit(n)


def is_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows with done: whether their key is in the table of done keys."""
    return rows.join(done.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("done", F.coalesce("_hit", F.lit(False))).drop("_hit")


def last_wins(records: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last record in the order."""
    return records.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(key, "_last.*")


def solved_total(solved: DataFrame, recent: DataFrame) -> DataFrame:
    """How many keys are solved for certain: those of provider-dated solves and of recent accepts."""
    return solved.select("key").unionByName(recent.select("key")).agg(F.countDistinct("key").alias("n"))


def sync_summary(accounts: DataFrame) -> DataFrame:
    """The oldest sync and the platforms; one row, as accounts are few."""
    return accounts.agg(F.min("synced_at").alias("oldest"), F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"))


def valid_records(records: DataFrame, *more: Column) -> DataFrame:
    """Records with an id, a key and an instant after 1970, and what else is asked of them."""
    sound = F.col("id").isNotNull() & (F.col("id").cast("string") != "") & F.col("key").isNotNull() & (F.col("ts") > F.timestamp_seconds(F.lit(0)))
    for condition in more:
        sound = sound & condition
    return records.filter(F.coalesce(sound, F.lit(False)))


def rated_in(points: DataFrame, year: int, zone: str) -> DataFrame:
    """Finite ratings after 1970 within a local year."""
    return points.filter(F.col("rating").isNotNull() & ~F.isnan("rating") & (F.col("ts") > F.timestamp_seconds(F.lit(0))) & (F.year(F.from_utc_timestamp("ts", zone)) == year))


def daily_solved(targets: DataFrame, records: DataFrame, day: Column, local_day: Column) -> DataFrame:
    """The daily problems (key) accepted on exactly their provider's day."""
    return targets.select("key").distinct().join(records.filter(local_day == day).select("key"), "key", "left_semi")


def stale(accounts: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Accounts last tried that long ago, or never."""
    return accounts.filter(F.col("attempted").isNull() | (F.unix_seconds(now) - F.unix_seconds("attempted") >= minutes * 60))


def count_of(text: Column) -> Column:
    """A count in a source's record: whole and not below 0; anything else is 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.when(text.rlike(r"^-?\d{1,18}$"), text.cast("long")), F.lit(0).cast("long")))


def exported(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, json: each row as a JSON object."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))


def fenced(events: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Events of the generation that their account (key, generation) has now; those of earlier ones are dropped."""
    return events.join(current.select(key, "generation"), [key, "generation"])


def sticky(records: DataFrame, by: list[str], done: Column) -> DataFrame:
    """by, done: once done within a key stays done."""
    return records.groupBy(*by).agg(F.bool_or(F.coalesce(done, F.lit(False))).alias("done"))


def day_badges(records: DataFrame, zone: str) -> DataFrame:
    """day, n: distinct problems of each local day, as the badge shows them."""
    return records.groupBy(record_day(zone).alias("day")).agg(F.countDistinct("key").alias("n"))
