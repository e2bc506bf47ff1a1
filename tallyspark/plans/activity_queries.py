"""Activity operators on events: platform is the event type, a problem is event_type:user_id, purchases report a calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import activity as A
from tallyspark.plans.base import Registry

R = Registry()
ZONE, TODAY, YEAR = "Asia/Kolkata", "2024-01-20", 2024
DAY = "CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS DATE)"
today = lambda: F.lit(TODAY).cast("date")


def records(t):
    e = t("events")
    return e.select(
        F.col("event_type").alias("platform"), F.col("event_id").alias("id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.concat_ws(" ", F.lit("Problem"), "event_type", F.col("user_id").cast("string")).alias("title"),
        "ts", F.when(F.col("event_id") % 7 == 0, F.to_date("ts")).alias("day"), (F.col("event_id") % 3 == 0).alias("pending"), "user_id", "value",
    )


def calendar(t):
    return t("events").filter("event_type = 'purchase'").groupBy(F.col("event_type").alias("platform"), F.to_date("ts").alias("day")).agg(F.count("*").alias("count"))


def accounts(t):
    return t("events").groupBy(F.col("event_type").alias("platform")).agg(F.expr("percentile(unix_seconds(ts), 0.5)").cast("long").cast("timestamp").alias("synced_at"), F.max("value").alias("current"))


BASE = f"""r AS (SELECT event_type AS platform, event_id AS id, event_type || ':' || user_id AS key, 'Problem ' || event_type || ' ' || user_id AS title, ts, CASE WHEN event_id % 7 = 0 THEN CAST(ts AS DATE) ELSE {DAY} END AS day, event_id % 3 = 0 AS pending, user_id, value FROM events),
acc AS (SELECT event_type AS platform, make_timestamp(CAST(floor(quantile_cont(floor(epoch(ts)), 0.5)) AS BIGINT) * 1000000) AS synced_at, max(value) AS current FROM events GROUP BY 1)"""
DAILY = f"""{BASE}, a01 AS (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(ts AS DATE) AS day, 1 AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT day, 1 FROM r LEFT JOIN acc USING (platform) WHERE platform <> 'purchase' OR (pending AND ts > synced_at)) GROUP BY day)"""


@R.add("a01_daily_activity", f"WITH {DAILY} SELECT day, n FROM a01")
def a01(t):
    return A.daily_activity(records(t), calendar(t), accounts(t), ZONE)


@R.add("w01_streaks", f"""WITH {BASE}, d AS (SELECT DISTINCT user_id, day FROM r WHERE day <= DATE '{TODAY}'), i AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island, day FROM d),
g AS (SELECT user_id, island, count(*) AS run, max(day) AS last FROM i GROUP BY 1, 2) SELECT user_id, coalesce(max(CASE WHEN last >= DATE '{TODAY}' - 1 THEN run END), 0) AS current, max(run) AS longest FROM g GROUP BY user_id""")
def w01(t):
    r = records(t)
    counts = r.groupBy("user_id", A.record_day(ZONE).alias("day")).agg(F.count("*").alias("n"))
    return A.streaks(counts, today(), ("user_id",))


@R.add("w08_calendar_overlay", f"WITH {BASE} SELECT platform, count(*) AS n FROM r JOIN acc USING (platform) WHERE pending AND ts > synced_at GROUP BY platform")
def w08(t):
    return A.overlay(records(t), accounts(t)).groupBy("platform").agg(F.count("*").alias("n"))


@R.add("a02_accepted_today", f"WITH {BASE} SELECT count(DISTINCT key) AS n FROM r WHERE day = DATE '{TODAY}'")
def a02(t):
    return A.accepted_today(records(t), today(), ZONE)


@R.add("a03_practice_today", f"WITH {BASE} SELECT (SELECT count(DISTINCT key) FROM r WHERE platform <> 'purchase' AND day = DATE '{TODAY}') + (SELECT count(*) FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = DATE '{TODAY}') AS n")
def a03(t):
    return A.practice_today(records(t), calendar(t), F.lit(f"{TODAY} 12:00:00").cast("timestamp"), ZONE, "purchase")


@R.add("a04_practice_overview", "SELECT CAST(sum(n) AS BIGINT) AS total, bool_or(n > 2005) AS lower_bound, string_agg(CASE WHEN n > 1990 THEN event_type END, ' ' ORDER BY event_type) AS notice FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a04(t):
    s = t("events").groupBy("event_type").agg(F.count("*").alias("total_solved"))
    return A.overview(s.select("total_solved", (F.col("total_solved") > 2005).alias("lower_bound"), F.when(F.col("total_solved") > 1990, F.col("event_type")).alias("notice")))


RECENT, SOLVED = "id % 4 > 0", "id % 4 = 0"


def done(t):
    r = records(t).drop("pending", "user_id", "value")
    return r.filter(RECENT), r.filter(SOLVED).withColumns({"ts": F.lit(None).cast("timestamp"), "day": F.lit(None).cast("date")})


DONE = f"""{BASE}, l AS (SELECT key, platform, title, ts, day FROM r WHERE {RECENT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, id) = 1), u AS (SELECT * FROM l UNION ALL SELECT DISTINCT key, platform, title, NULL::TIMESTAMP, NULL::DATE FROM r WHERE {SOLVED} AND key NOT IN (SELECT key FROM l))"""


@R.add("a05_done_questions", f"WITH {DONE} SELECT key, title, (SELECT count(*) FROM u) AS total, row_number() OVER (ORDER BY ts DESC NULLS LAST, key) AS rn FROM u WHERE title ILIKE '%problem%' AND title ILIKE '%1%' AND day BETWEEN DATE '2024-01-05' AND DATE '{TODAY}'")
def a05(t):
    recent, solved = done(t)
    return A.done_questions(recent, solved, "Problem 1", first=F.lit("2024-01-05").cast("date"), last=today(), zone=ZONE).select("key", "title", "total", F.col("rn").cast("long").alias("rn"))


@R.add("f04_done_filter", f"WITH {DONE} SELECT platform, count(*) AS n FROM u WHERE day >= DATE '2024-01-10' AND platform = 'click' GROUP BY platform")
def f04(t):
    recent, solved = done(t)
    return A.done_questions(recent, solved, platform="click", first=F.lit("2024-01-10").cast("date"), zone=ZONE).groupBy("platform").agg(F.count("*").alias("n"))


@R.add("a06_question_is_done", "SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS done FROM customer")
def a06(t):
    done = t("events").select(F.col("user_id").alias("c_custkey"))
    return A.is_done(t("customer").select("c_custkey"), done, "c_custkey")


@R.add("a13_heatmap_summary", f"WITH {DAILY} SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM a01 WHERE year(day) = {YEAR} AND day <= DATE '{TODAY}' AND n > 0")
def a13(t):
    return a01(t).filter((F.year("day") == YEAR) & (F.col("day") <= today()) & (F.col("n") > 0)).agg(F.sum("n").alias("n"), F.count("*").alias("days"))


@R.add("j16_heatmap", f"WITH {DAILY}, s AS (SELECT CAST(unnest(generate_series(DATE '{YEAR}-01-01', DATE '{YEAR}-12-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT s.day, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN n < 3 THEN 1 WHEN n < 6 THEN 2 WHEN n < 10 THEN 3 ELSE 4 END AS level FROM s LEFT JOIN a01 ON s.day = a01.day AND a01.day <= DATE '{TODAY}'")
def j16(t):
    return A.heatmap(a01(t), YEAR, today())


@R.add("a23_last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a23(t):
    return A.last_wins(t("events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@R.add("w02_latest_per_key", f"WITH {BASE} SELECT key, id, ts FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, id) = 1")
def w02(t):
    return A.newest(records(t), 1, [F.desc("ts"), F.asc("id")], ("key",)).select("key", "id", "ts")


@R.add("w03_score_history", "WITH l AS (SELECT event_type AS platform, CAST(ts AS DATE) AS day, value AS score, ts FROM events WHERE event_id % 10 > 0 QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, value DESC) = 1) SELECT platform, day, score FROM l QUALIFY row_number() OVER (PARTITION BY platform ORDER BY day DESC) <= 18")
def w03(t):
    seen = t("events").select(F.col("event_type").alias("platform"), "ts", F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("score"))
    return A.score_history(seen, 18).select("platform", "day", "score")


@R.add("w04_recent_retention", "SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) > 1500 AS clipped FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 1500")
def w04(t):
    return A.newest(t("events"), 1500, [F.desc("ts"), F.asc("event_id")], ("event_type",)).select("event_type", "event_id", "clipped")


@R.add("w05_daily_history", "SELECT user_id, day FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 7")
def w05(t):
    return A.newest(t("events").select("user_id", F.to_date("ts").alias("day")).distinct(), 7, [F.desc("day")], ("user_id",)).select("user_id", "day")


@R.add("w06_ranks", "SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY 1, 2 QUALIFY rn <= 5")
def w06(t):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return A.newest(counts, 5, [F.desc("n"), F.asc("user_id")], ("event_type",)).select("user_id", "event_type", "n", F.col("r").cast("long").alias("rn"))


@R.add("w07_rating_series", f"WITH {BASE}, p AS (SELECT platform, ts, value AS rating FROM r WHERE platform <> 'click'), x AS (SELECT * FROM p UNION ALL SELECT platform, synced_at, current FROM acc WHERE platform NOT IN (SELECT platform FROM p)) SELECT platform, ts, rating, row_number() OVER (PARTITION BY platform ORDER BY ts, rating) AS n FROM x WHERE year((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata') = {YEAR}")
def w07(t):
    points = records(t).filter("platform <> 'click'").select("platform", "ts", F.col("value").alias("rating"))
    return A.rating_series(points, accounts(t), YEAR, ZONE).withColumn("n", F.col("n").cast("long"))


@R.add("f12_rating_filter", f"WITH {BASE} SELECT platform, count(*) AS n FROM r WHERE value > 1 AND year((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata') = {YEAR} GROUP BY 1")
def f12(t):
    points = records(t).filter(F.col("value") > 1).withColumn("rating", F.col("value"))
    return A.rated_in(points, YEAR, ZONE).groupBy("platform").agg(F.count("*").alias("n"))


@R.add("k09_recent_keys", f"WITH {BASE} SELECT key, max(ts) AS ts FROM r GROUP BY key ORDER BY 2 DESC, 1 LIMIT 12")
def k09(t):
    return A.recent_keys(records(t))


@R.add("k16_last_rating", "SELECT event_type AS platform, max_by(value, event_id) AS rating FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY event_type, ts) AND ts IN (SELECT max(ts) FROM events GROUP BY event_type) GROUP BY 1")
def k16(t):
    return A.last_rating(t("events").select(F.col("event_type").alias("platform"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("rating")))


@R.add("a24_solved_total", f"WITH {BASE} SELECT count(*) AS n FROM (SELECT key FROM r WHERE {SOLVED} UNION SELECT key FROM r WHERE {RECENT} AND value > 50)")
def a24(t):
    r = records(t)
    return A.solved_total(r.filter(SOLVED), r.filter(f"{RECENT} AND value > 50"))


@R.add("a25_sync_summary", f"WITH {BASE} SELECT min(synced_at) AS oldest, string_agg(platform, ',' ORDER BY platform) AS platforms FROM acc")
def a25(t):
    return A.sync_summary(accounts(t))


@R.add("f11_record_validity", "SELECT count(*) AS n FROM events WHERE event_id > 0 AND user_id IS NOT NULL AND epoch(ts) > 0 AND value > 0.5")
def f11(t):
    rows = t("events").select(F.when(F.col("event_id") > 0, F.col("event_id")).alias("id"), F.col("user_id").alias("key"), "ts", "value")
    return A.valid_records(rows, F.col("value") > 0.5).agg(F.count("*").alias("n"))


@R.add("f21_daily_solved", f"WITH {BASE} SELECT DISTINCT key FROM r WHERE platform = 'click' AND CAST(ts AS DATE) = DATE '{TODAY}'")
def f21(t):
    return A.daily_solved(records(t).filter("key LIKE 'click:%'"), records(t), today(), F.to_date("ts"))


@R.add("ts01_merge_snapshot", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events GROUP BY user_id")
def ts01(t):
    """Keyed upsert of two snapshots, the later record of a key wins; the streaming twin is tested against this."""
    e = t("events")
    merged = e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 2 = 1"))
    seen = merged.groupBy("user_id").agg(F.count("*").alias("seen"))
    return A.last_wins(merged, "user_id", ["ts", "event_id"], ["ts", "event_id"]).join(seen, "user_id")


@R.add("ts02_sticky_daily", "SELECT user_id, CAST(ts AS DATE) AS day, bool_or(value > 80) AS done FROM events GROUP BY 1, 2")
def ts02(t):
    return A.sticky(t("events").withColumn("day", F.to_date("ts")), ["user_id", "day"], F.col("value") > 80)


@R.add("ts13_badge", f"WITH {BASE} SELECT day, count(DISTINCT key) AS n FROM r GROUP BY day")
def ts13(t):
    return A.day_badges(records(t), ZONE)


@R.add("ts21_stale_scan", "SELECT event_type, max(ts) AS attempted FROM events GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31 00:20:00' - max(ts)) >= 1800")
def ts21(t):
    return A.stale(t("events").groupBy("event_type").agg(F.max("ts").alias("attempted")), F.lit("2024-01-31 00:20:00").cast("timestamp"))


@R.add("p40_source_record", "SELECT event_type || ':' || event_id AS id, event_type || ':' || user_id AS key, greatest(0, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS n FROM events")
def p40(t):
    n = A.count_of(F.get_json_object("props", "$.k"))
    return t("events").select(F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), n.alias("n"))


@R.add("ks07_json_export", """SELECT user_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""")
def ks07(t):
    return A.exported(t("events"), "user_id", ["event_id", "event_type"])


@R.add("ts05_generation_fence", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 5 = length(event_type) % 5 GROUP BY 1")
def ts05(t):
    current = t("events").select("event_type").distinct().withColumn("generation", (F.length("event_type") % 5).cast("long"))
    return A.fenced(t("events").withColumn("generation", F.col("event_id") % 5), current, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))