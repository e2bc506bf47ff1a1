"""Text, URL and time functions over documents, pages, part, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions import times, urls
from tallyspark.plans.base import Registry

R = Registry()

WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
CLEAN = (
    "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<sup\\b[^>]*>(.*?)</sup>', '^(\\1)', 'g'), '(?is)<sub\\b[^>]*>(.*?)</sub>', '_(\\1)', 'g'), "
    "'(?i)</?(?:p|div|span|br|pre|code|strong|b|em|i|ul|ol|li|sub|sup|h[1-6]|table|tr|td|th|a)\\b[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
)
DISTINCT = "list_transform(list_filter(list_transform({0}, lambda x, i: {{'x': x, 'first': list_position({0}, x) = i}}), lambda r: r.first), lambda r: r.x)"
TITLE = "array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ')"


def title(docs):
    return F.array_join(F.slice(F.split("text", " ", 7), 1, 6), " ")


@R.add("p01_clean_text", f"SELECT page_id, {CLEAN.format('html')} AS cleaned FROM pages")
def p01(t):
    return t("pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


@R.add("p02_text_key", f"SELECT doc_id, lower({CLEAN.format('text')}) AS text_key FROM documents")
def p02(t):
    return t("documents").select("doc_id", T.text_key(F.col("text")).alias("text_key"))


KEY = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\b(a|an|the)\\b', ' ', 'g'), '[^\\p{{L}}\\p{{N}}+<>=-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@R.add("p03_title_key", f"SELECT doc_id, CASE WHEN lang = 'en' THEN {KEY.format(f'''regexp_replace(lower({CLEAN.format(TITLE)}), '^[a-z]\\.\\s+', '')''')} ELSE {KEY.format(f'lower({CLEAN.format(TITLE)})')} END AS title_key FROM documents")
def p03(t):
    return t("documents").select("doc_id", T.title_key(title(None), F.when(F.col("lang") == "en", "codeforces").otherwise("leetcode")).alias("title_key"))


@R.add("p04_fingerprint", f"""SELECT doc_id, 'sha256:' || sha256('["' || replace(replace(c, '\\', '\\\\'), '"', '\\"') || '","' || source || '"]') AS fingerprint FROM (SELECT doc_id, source, {CLEAN.format('text')} AS c FROM documents)""")
def p04(t):
    return t("documents").select("doc_id", T.fingerprint(T.clean_text(F.col("text")), F.col("source")).alias("fingerprint"))


@R.add("p05_review_fingerprint", """SELECT p_partkey, 'sha256:' || sha256('["' || p_name || '","' || p_brand || '"]') AS review_fingerprint FROM part""")
def p05(t):
    return t("part").select("p_partkey", T.review_fingerprint(F.col("p_name"), F.col("p_brand")).alias("review_fingerprint"))


PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/')"


@R.add("p06_problem_key", f"SELECT page_id, p || ':' || CASE WHEN p = 'codechef' THEN list_extract(string_split(path, '/'), -1) ELSE path END AS key FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'codechef' ELSE 'tuf' END AS p, regexp_replace({PATH}, '/+$', '') AS path FROM pages)")
def p06(t):
    return t("pages").select("page_id", urls.problem_key(F.when(F.col("page_id") % 2 == 0, "codechef").otherwise("tuf"), F.col("url")).alias("key"))


MADE = "CASE page_id % 5 WHEN 0 THEN 'https://leetcode.com/problems/p-' || page_id || '/solutions?x=1' WHEN 1 THEN 'https://www.codeforces.com/contest/' || page_id || '/problem/a1' WHEN 2 THEN 'https://atcoder.jp/contests/abc' || page_id || '/tasks/abc_' || page_id WHEN 3 THEN url ELSE 'http://leetcode.com/problems/p/' END"
MADE_PLATFORM = "CASE page_id % 5 WHEN 0 THEN 'leetcode' WHEN 1 THEN 'codeforces' WHEN 2 THEN 'atcoder' ELSE 'leetcode' END"


def made(t):
    return t("pages").select("page_id", F.expr(MADE).alias("url"), F.expr(MADE_PLATFORM).alias("platform"))


@R.add("p07_safe_problem_url", f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 2) THEN {MADE} END AS safe_url FROM pages")
def p07(t):
    return made(t).select("page_id", urls.safe_problem_url(F.col("url"), F.col("platform")).alias("safe_url"))


@R.add("p08_import_question", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'leetcode' WHEN 1 THEN 'codeforces' WHEN 2 THEN 'atcoder' END AS platform, CASE page_id % 5 WHEN 0 THEN 'https://leetcode.com/problems/p-' || page_id || '/' WHEN 1 THEN 'https://codeforces.com/contest/' || page_id || '/problem/a1' WHEN 2 THEN 'https://atcoder.jp/contests/abc' || page_id || '/tasks/abc_' || page_id END AS url, CASE page_id % 5 WHEN 0 THEN 'p-' || page_id WHEN 1 THEN 'a1' WHEN 2 THEN 'abc_' || page_id END AS title FROM pages")
def p08(t):
    url = F.col("url")
    return made(t).select("page_id", urls.import_platform(url).alias("platform"), urls.import_url(url).alias("url"), urls.import_title(url, F.lit(None).cast("string")).alias("title"))


@R.add("p09_clean_handle", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'user_' || c_custkey END AS handle FROM customer")
def p09(t):
    typed = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('https://leetcode.com/u/user_', c_custkey, '/') WHEN 1 THEN concat(' @user_', c_custkey) ELSE concat('https://leetcode.com/problems/x', c_custkey) END")
    return t("customer").select("c_custkey", urls.clean_handle("leetcode", typed).alias("handle"))


@R.add("p10_date_key", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS DATE) AS day FROM events")
def p10(t):
    return t("events").select("event_id", times.date_key(F.col("ts"), times.INDIA).alias("day"))


@R.add("p11_shift_day", "SELECT event_id, CAST(ts AS DATE) + 1 AS next_day, CAST(ts AS DATE) - 30 AS before FROM events")
def p11(t):
    day = F.to_date("ts")
    return t("events").select("event_id", times.shift_day(day, 1).alias("next_day"), times.shift_day(day, -30).alias("before"))


@R.add("p12_daily_day", "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(ts AS DATE) ELSE CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS DATE) END AS day FROM events")
def p12(t):
    return t("events").select("event_id", times.daily_day(F.when(F.col("event_type") == "click", "leetcode").otherwise("tuf"), F.col("ts")).alias("day"))


@R.add("p13_next_badge_reset", "SELECT o_orderkey, (CAST(CAST((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) + 1 AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS reset FROM orders")
def p13(t):
    return t("orders").select("o_orderkey", times.next_midnight(F.col("o_orderdate"), "America/New_York").alias("reset"))


NOW = "1996-06-01 12:34:56"
M = f"CAST(ceil((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '{NOW}')) / 60000.0) AS BIGINT)"


@R.add("p14_countdown", f"SELECT o_orderkey, CASE WHEN TIMESTAMP '{NOW}' >= o_orderdate + to_days(CAST(o_orderkey % 14 + 1 AS INT)) THEN 'Ended' WHEN TIMESTAMP '{NOW}' >= o_orderdate THEN 'Live' WHEN {M} >= 1440 THEN 'in ' || ({M} // 1440) || 'd ' || ({M} % 1440 // 60) || 'h' WHEN {M} >= 60 THEN 'in ' || ({M} // 60) || 'h ' || ({M} % 60) || 'm' ELSE 'in ' || {M} || 'm' END AS countdown FROM orders")
def p14(t):
    end = F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 14 + 1 AS INT))")
    return t("orders").select("o_orderkey", times.countdown(F.col("o_orderdate"), end, F.lit(NOW).cast("timestamp")).alias("countdown"))


TOKENS = DISTINCT.format(f"list_filter({WORDS.format('lower(text)')}, lambda x: NOT list_contains({LIST(T.SEARCH_STOP)}, x))")


def distinct_sql(source: str, column: str, arrays: str) -> str:
    """Rows of distinct values with their order of first use, the simplest way to say it in SQL."""
    return f"SELECT {source}, string_agg(x, ' ' ORDER BY p) AS {column} FROM (SELECT {source}, x, min(p) AS p FROM (SELECT {source}, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM ({arrays})) GROUP BY {source}, x) GROUP BY {source}"


STOPPED = f"list_filter({WORDS.format('lower({0})')}, lambda x: NOT list_contains({LIST(T.SEARCH_STOP)}, x))".replace("{{", "{").replace("}}", "}")


@R.add("p15_tokens", distinct_sql("doc_id", "tokens", f"SELECT doc_id, {STOPPED.replace('{0}', 'text')} AS a FROM documents"))
def p15(t):
    return t("documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens")).filter("tokens <> ''")


def retrieval_sql(text: str, statement: bool) -> str:
    a = STOPPED.replace("{0}", f"regexp_replace({text}, '(?i)\\b([234])sum\\b', '\\1 sum', 'g')")
    if not statement:
        a = f"list_transform({a}, lambda x: CASE x WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four' ELSE x END)"
    a = f"list_transform({a}, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' AND NOT regexp_matches(x, '(ss|us|is)$') THEN left(x, -1) ELSE x END)"
    a = f"list_transform({a}, lambda x: CASE x {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in T.SYNONYMS.items())} ELSE x END)"
    drop = f" AND NOT list_contains({LIST(T.BOILERPLATE)}, x)" if statement else ""
    return f"list_filter({a}, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND length(x) >= 2{drop})"


@R.add("p16_retrieval_tokens", distinct_sql("doc_id", "tokens", f"SELECT doc_id, {retrieval_sql('text', True)} AS a FROM documents"))
def p16(t):
    return t("documents").select("doc_id", F.array_join(T.retrieval_tokens(F.col("text"), True), " ").alias("tokens")).filter("tokens <> ''")


def step_sql(a: str, body: str) -> str:
    return f"list_transform({a}, lambda w: CASE WHEN length(w) <= 2 AND w NOT LIKE '%|%' THEN w ELSE {body} END)"


def stem_sql(a: str) -> str:
    """The stemmer, step after step. Words of up to two letters are set apart with a leading blank, and get it off at the end."""
    m = lambda s: f"len(regexp_extract_all({s}, '[aeiou][^aeiou]'))"
    cut = lambda n: f"left(w, greatest(length(w) - {n}, 0))"
    each = lambda a, body: f"list_transform({a}, lambda w: CASE WHEN w LIKE ' %' THEN w ELSE {body} END)"
    closed = lambda s: f"regexp_matches({s}, '[^aeiou][aeiou][^aeiouwxy]$')"
    double = "(" + " OR ".join(f"w LIKE '%{c}{c}|'" for c in "bcdfghjkmnpqrtvwxy") + " OR regexp_matches(w, '(00|11|22|33|44|55|66|77|88|99)\\|$'))"
    body = cut(1)
    a = f"list_transform({a}, lambda w: CASE WHEN length(w) <= 2 THEN ' ' || w ELSE w END)"
    a = each(a, f"CASE WHEN regexp_matches(w, '(sses|ies)$') THEN {cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {cut(1)} ELSE w END")
    a = each(a, f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {m(cut(3))} > 0 THEN {cut(1)} ELSE w END WHEN w LIKE '%ed' THEN CASE WHEN regexp_matches({cut(2)}, '[aeiou]') THEN {cut(2)} || '|' ELSE w END WHEN w LIKE '%ing' THEN CASE WHEN regexp_matches({cut(3)}, '[aeiou]') THEN {cut(3)} || '|' ELSE w END ELSE w END")
    a = each(a, f"CASE WHEN w NOT LIKE '%|' THEN w WHEN regexp_matches(w, '(at|bl|iz)\\|$') THEN {body} || 'e' WHEN {double} THEN {cut(2)} WHEN {m(body)} = 1 AND {closed(body)} THEN {body} || 'e' ELSE {body} END")
    a = each(a, f"CASE WHEN w LIKE '%y' AND regexp_matches({cut(1)}, '[aeiou]') THEN {cut(1)} || 'i' ELSE w END")
    for table, least in ((T.STEP_2, 0), (T.STEP_3, 0), ([(s, "") for s in T.STEP_4], 1)):
        a = each(a, "CASE " + " ".join(f"WHEN w LIKE '%{s}' AND {m(cut(len(s)))} > {least} THEN {cut(len(s))} || '{to}'" for s, to in table) + " ELSE w END")
    a = each(a, f"CASE WHEN regexp_matches(w, '[st]ion$') AND {m(cut(3))} > 1 THEN {cut(3)} ELSE w END")
    a = each(a, f"CASE WHEN w LIKE '%e' AND ({m(cut(1))} > 1 OR ({m(cut(1))} = 1 AND NOT {closed(cut(1))})) THEN {cut(1)} ELSE w END")
    a = each(a, f"CASE WHEN w LIKE '%ll' AND {m('w')} > 1 THEN {cut(1)} ELSE w END")
    return f"list_transform({a}, lambda w: ltrim(w))"


def match_sql(text: str) -> str:
    stop = LIST(T.MATCH_STOP)
    a = f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({stop}, w))"
    return f"list_filter({stem_sql(a)}, lambda w: length(w) >= 2 AND NOT list_contains({stop}, w))"


@R.add("p17_match_tokens", distinct_sql("doc_id", "tokens", f"SELECT doc_id, {match_sql('text')} AS a FROM documents"))
def p17(t):
    return t("documents").select("doc_id", F.array_join(T.match_tokens(F.col("text")), " ").alias("tokens")).filter("tokens <> ''")


VOCABULARY = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"


@R.add("p18_stem", f"SELECT word, {stem_sql('[word]')}[1] AS stem FROM ({VOCABULARY})")
def p18(t):
    vocabulary = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return vocabulary.select("word", T.stemmed(F.array("word"))[0].alias("stem"))


@R.add("p19_bigrams", "SELECT p_partkey, array_to_string(list_transform(range(1, greatest(len(a), 1)), lambda i: a[i] || ' ' || a[i + 1]), ',') AS bigrams FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")
def p19(t):
    return t("part").select("p_partkey", F.array_join(T.bigrams(F.split("p_name", " ")), ",").alias("bigrams"))


@R.add("p20_threshold", "SELECT event_id, CASE WHEN value BETWEEN 0.1 AND 1 THEN value ELSE 0.4 END AS threshold FROM events")
def p20(t):
    return t("events").select("event_id", T.threshold(F.col("value")).alias("threshold"))


@R.add("p21_library_normal", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normal FROM documents")
def p21(t):
    return t("documents").select("doc_id", T.search_normal(F.col("text")).alias("normal"))


@R.add("p34_html_text", "SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text FROM pages")
def p34(t):
    return t("pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@R.add("p35_india_time", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate - INTERVAL 330 MINUTE END AS ts FROM orders")
def p35(t):
    text = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return t("orders").select("o_orderkey", times.india_time(text).alias("ts"))


@R.add("p36_heat_level", "SELECT event_id, CASE WHEN e <= 0 THEN 0 WHEN e < 3 THEN 1 WHEN e < 6 THEN 2 WHEN e < 10 THEN 3 ELSE 4 END AS level FROM (SELECT event_id, event_id % 13 AS e FROM events)")
def p36(t):
    return t("events").select("event_id", times.heat_level(F.col("event_id") % 13).alias("level"))


@R.add("p37_chart_scale", "SELECT event_type, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, CAST(greatest(100, ceil(greatest(0, max(value)) / 100) * 100) AS BIGINT) AS top FROM events GROUP BY event_type")
def p37(t):
    return t("events").groupBy("event_type").agg(*times.chart_scale(F.col("ts"), F.col("value")))


AGO = "(epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(ts)) // 60000"


@R.add("p38_time_ago", f"SELECT event_id, CASE WHEN {AGO} < 1 THEN 'Updated just now' WHEN {AGO} < 60 THEN 'Updated ' || ({AGO}) || 'm ago' WHEN {AGO} < 1440 THEN 'Updated ' || ({AGO} // 60) || 'h ago' ELSE 'Updated ' || ({AGO} // 1440) || 'd ago' END AS ago FROM events")
def p38(t):
    return t("events").select("event_id", times.time_ago(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("ago"))


@R.add("p49_month_days", "SELECT m AS month, CAST(unnest(generate_series(m - CAST(dayofweek(m) AS INT), last_day(m) + (6 - CAST(dayofweek(last_day(m)) AS INT)), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)")
def p49(t):
    return t("orders").select(F.to_date(F.trunc("o_orderdate", "month")).alias("month")).distinct().select("month", F.explode(times.month_days(F.col("month"))).alias("day"))


@R.add("p51_retrieval_body", "SELECT doc_id, left(text, 10000) AS body FROM documents")
def p51(t):
    return t("documents").select("doc_id", T.retrieval_body(F.col("text")).alias("body"))


@R.add("p52_search_statement", "SELECT source, sum(length(s)) AS chars FROM (SELECT source, left(string_agg(text, ' ' ORDER BY text), 12000) AS s FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source) GROUP BY source")
def p52(t):
    return t("documents").groupBy("source").agg(F.length(T.joined_statement(F.collect_set("text"))).cast("long").alias("chars"))


@R.add("p53_daily_key", "SELECT c_custkey, 'done:' || c_mktsegment || ':' || lower(c_name) AS key FROM customer")
def p53(t):
    return t("customer").select("c_custkey", times.daily_key(F.col("c_mktsegment"), F.col("c_name")).alias("key"))


@R.add("p50_reminder_key", "SELECT o_orderkey, 'contest:' || o_orderkey || ':' || epoch_ms(o_orderdate) || ':60' AS name FROM orders")
def p50(t):
    return t("orders").select("o_orderkey", times.reminder_key(F.col("o_orderkey"), F.col("o_orderdate"), F.lit(60)).alias("name"))