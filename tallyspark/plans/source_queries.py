"""Parsers of provider pages on pages made from the driver tables; SQL states what the made pages say."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import video_query
from tallyspark.operators import contests as C
from tallyspark.operators.graphs import cut
from tallyspark.plans.base import Registry
from tallyspark.sources import feeds
from tallyspark.sources.readers import spread

R = Registry()


def made(df, *parts):
    """Rows with one html column put together of texts and columns."""
    return df.select(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("html"))


@R.add("s09_s10_accepted_feed", "SELECT 'P' || user_id AS code, CAST(event_id AS VARCHAR) AS id, date_trunc('minute', ts) AS ts FROM events WHERE event_type = 'click'")
def s09(t):
    local = F.from_utc_timestamp("ts", "Asia/Kolkata")
    row = made(t("events"), "<tr><td>", F.date_format(local, "hh:mm a dd/MM/yy"), "</td><td><a href='/problems/P", F.col("user_id"), "'>p</a></td><td title='", F.when(F.col("event_type") == "click", "accepted").otherwise("wrong"), "'></td><td><a href='/viewsolution/", F.col("event_id"), "'>v</a></td></tr>")
    return feeds.accepted_feed(row).select("code", "id", "ts")


@R.add("s11_embedded_calendar", "SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events GROUP BY 1")
def s11(t):
    days = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    entry = F.concat(F.lit('{"date":"'), F.date_format("day", "yyyy-M-d"), F.lit('","value":'), F.col("n").cast("string"), F.lit("}"))
    one = days.agg(F.array_join(F.collect_list(entry), ",").alias("list"))
    return feeds.embedded_calendar(made(one, "<script>const userDailySubmissionsStats = [", F.col("list"), "];</script>"))


@R.add("s12_difficulty_map", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'geeksforgeeks:p' || p_partkey AS key, p_name AS title, p_brand AS difficulty, CASE WHEN p_size % 2 = 0 THEN DATE '2024-01-02' END AS day FROM part")
def s12(t):
    inner = F.to_json(F.create_map(F.col("p_brand"), F.create_map(F.col("p_partkey").cast("string"), F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("pname"), F.when(F.col("p_size") % 2 == 0, "2024-01-02 10:00:00").alias("user_subtime")))))
    return feeds.difficulty_map(t("part").select(inner.alias("json")))


@R.add("s14_history_page", "SELECT 'code360:/code360/problems/c' || (c_custkey % 500) AS key, max(CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_minutes(c_custkey) END) AS ts FROM customer WHERE c_custkey % 7 > 0 GROUP BY 1")
def s14(t):
    c = F.col("c_custkey")
    link = F.when(c % 7 == 0, F.lit("https://elsewhere.example/x")).otherwise(F.concat(F.when(c % 2 == 0, "/code360/problems/c").otherwise("https://www.codingninjas.com/studio/problems/c"), (c % 500).cast("string")))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + c * 60_000_000)
    solved = F.when(c % 3 > 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("2024-01-01 10:00")
    # links and instants cost far more than moving two columns, and a file of one row group is one task. Kept, as filters would move below the exchange and take the work along
    rows = cut(spread(t("customer").select("c_custkey", "c_name"))).select(link.alias("link"), F.col("c_name").alias("title"), solved.alias("solved_at"))
    return feeds.history_page(rows, F.lit("2030-01-01").cast("timestamp")).select("key", "ts")


@R.add("s17_profile_table", "SELECT s_suppkey, s_suppkey * 1000 AS rating, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS rank FROM supplier")
def s17(t):
    s = F.col("s_suppkey")
    html = F.concat(F.lit("<tr><th>Rating</th><td><b>"), F.format_number(s * 1000, 0), F.lit("</b></td></tr><tr><th>Rank</th><td>"), F.when(s % 2 == 0, F.concat(s.cast("string"), F.lit("th"))).otherwise("none"), F.lit("</td></tr>"))
    return feeds.profile_table(t("supplier").select("s_suppkey", html.alias("html"))).select("s_suppkey", "rating", "rank")


@R.add("s29g_schedule_table", "SELECT 'atcoder-c' || o_orderkey AS id, date_trunc('second', o_orderdate) AS start, date_trunc('second', o_orderdate) + to_minutes(90) AS \"end\" FROM orders")
def s29g(t):
    html = made(t("orders"), "<tr><td><time>", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "+0000</time></td><td><a href='/contests/c", F.col("o_orderkey"), "'>Round</a></td><td>01:30</td></tr>")
    return C.normalize(feeds.schedule_table(html), "atcoder").select("id", "start", "end")


@R.add("s29d_s29e_s29f_schedules", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'codechef' WHEN 1 THEN 'code360' ELSE 'geeksforgeeks' END || '-c' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN date_trunc('second', o_orderdate) - INTERVAL 330 MINUTE ELSE date_trunc('second', o_orderdate) END AS start FROM orders")
def s29(t):
    o = t("orders")
    slug, s = F.concat(F.lit("c"), F.col("o_orderkey").cast("string")), F.unix_seconds("o_orderdate")
    iso = lambda c, zone: F.date_format(F.timestamp_seconds(c), f"yyyy-MM-dd'T'HH:mm:ss{zone}")
    a = o.filter("o_orderkey % 3 = 0").select(slug.alias("contest_code"), F.lit("R").alias("contest_name"), iso(s, "'Z'").alias("contest_start_date_iso"), iso(s + 3600, "'Z'").alias("contest_end_date_iso"), F.lit(0).alias("pos"))
    b = o.filter("o_orderkey % 3 = 1").select(slug.alias("slug"), F.lit("R").alias("name"), F.lit("CONTEST").alias("event_category"), s.alias("event_start_time"), (s + 3600).alias("event_end_time"), F.lit(0).alias("pos"))
    c = o.filter("o_orderkey % 3 = 2").select(slug.alias("slug"), F.lit("R").alias("name"), F.lit("R").alias("title"), F.lit(3).alias("type"), iso(s, "").alias("start_time"), iso(s + 3600, "").alias("end_time"), F.lit(0).alias("pos"))
    out = C.normalize(feeds.schedule_json(a, "iso"), "codechef").unionByName(C.normalize(feeds.schedule_json(b, "seconds"), "code360")).unionByName(C.normalize(feeds.schedule_json(c, "india"), "geeksforgeeks"))
    return out.select("id", "start")


@R.add("p31_sections_by_class", "SELECT p_partkey, p_name AS description, p_brand AS constraints FROM part")
def p31(t):
    html = F.concat(F.lit("<div class='problem-statement'><div class='header'>h</div><div>"), F.col("p_name"), F.lit("</div><div class='input-specification'>"), F.col("p_brand"), F.lit("</div></div>"))
    return t("part").select("p_partkey", feeds.statement_sections(html, "class").alias("s")).select("p_partkey", "s.*")


@R.add("p32_sections_by_heading", "SELECT p_partkey, p_name AS description, p_brand AS constraints FROM part")
def p32(t):
    html = F.concat(F.lit("<div id='task-statement'><h3>Problem Statement</h3><p>"), F.col("p_name"), F.lit("</p><h3>Constraints</h3>"), F.col("p_brand"), F.lit("</div>"))
    return t("part").select("p_partkey", feeds.statement_sections(html, "heading").alias("s")).select("p_partkey", "s.*")


@R.add("p39_video_query", "SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 2 = 0 THEN 'LeetCode ' || p_size END, p_name, 'solution') AS query FROM part")
def p39(t):
    return t("part").select("p_partkey", video_query(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "LeetCode").alias("query"))