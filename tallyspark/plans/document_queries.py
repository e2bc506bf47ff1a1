"""Documents of users and pages: backups, imports and script data, written from the driver's tables row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import backups
from tallyspark.operators.graphs import cut
from tallyspark.plans.base import Registry
from tallyspark.sources import flight, imports, profiles
from tallyspark.sources.contents import page_contents
from tallyspark.sources.readers import spread

R = Registry()


def text(*parts):
    return F.concat(*(F.col(p[1:]).cast("string") if isinstance(p, str) and p[:1] == "$" else p if not isinstance(p, str) else F.lit(p) for p in parts))


@R.add("f16_backups", """SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN 'not an object' ELSE array_to_string(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'daily goal' END, CASE WHEN c_custkey % 11 = 0 THEN 'forbidden key' END,
CASE WHEN c_custkey % 3 = 0 THEN 'list ids' END, CASE WHEN c_custkey % 5 = 0 THEN 'question' END], lambda x: x IS NOT NULL), ',') END AS faults FROM customer""")
def f16_backups(t):
    """A backup a customer, every few with a fault of one kind or another."""
    n = F.col("c_custkey")
    entry = text('{"platform":"leetcode","title":"', "$c_name", '","url":"https://leetcode.com/problems/p', "$c_custkey", '/","key":"leetcode:', F.when(n % 5 == 0, "other").otherwise(F.concat(F.lit("p"), n.cast("string"))), '"')
    key = F.when(n % 5 == 0, "leetcode:other").otherwise(F.concat(F.lit("leetcode:p"), n.cast("string")))
    doc = text(
        '{"version":1,"accounts":{"leetcode":{"handle":"u', "$c_custkey", '","snapshot":{"recent":[', entry, '}]}}},"lists":{"saved":{"id":"saved","name":"Saved"}},"workspace":{"', key, '":', entry, ',"listIds":["', F.when(n % 3 == 0, "gone").otherwise("saved"),
        '"]}},"settings":{"dailyGoal":', F.when(n % 7 == 0, "60").otherwise("5"), ',"timeZone":"Asia/Kolkata"', F.when(n % 11 == 0, ',"more":{"constructor":1}').otherwise(""), "}", F.when(n % 13 == 0, "").otherwise("}"),
    )
    return backups.validated(t("customer").select(n.alias("id"), doc.alias("text"))).select("id", F.array_join("faults", ",").alias("faults"))


@R.add("s24_imports", f"""SELECT page_id AS id, 1 AS "row", CASE WHEN page_id % 5 = 0 AND page_id % 3 <> 1 THEN 'duplicate' ELSE 'record' END AS state, CASE WHEN page_id % 3 = 1 THEN 'codechef:C' ELSE 'leetcode:p' END || page_id AS key, CASE page_id % 3 WHEN 0 THEN 'T' || page_id WHEN 1 THEN 'a, "b"' || chr(10) || 'c' ELSE 'p' || page_id END AS title, NULL AS reason FROM pages WHERE NOT (page_id % 3 = 1 AND page_id % 11 = 0)
UNION ALL SELECT page_id, 2, CASE WHEN page_id % 3 = 1 THEN 'duplicate' ELSE 'unresolved' END, CASE WHEN page_id % 3 = 1 THEN 'codechef:C' || page_id END, CASE WHEN page_id % 3 = 1 THEN 'z' END, CASE page_id % 3 WHEN 0 THEN '{imports.UNSUPPORTED}' WHEN 2 THEN '{imports.INVALID}' END FROM pages WHERE NOT (page_id % 3 = 1 AND page_id % 11 = 0)""")
def s24_imports(t):
    """An import a page, in one of three forms; some CSV has an open quote and is a fault."""
    n = F.col("page_id")
    json = text('[{"url":"https://leetcode.com/problems/p', "$page_id", '/","title":"T', "$page_id", '"},"https://leetcode.com/u/someone"]')
    csv = text('url,title\r\n"https://codechef.com/problems/C', "$page_id", '","a, ""b""\nc"\r\n\r\nhttps://www.codechef.com/problems/C', "$page_id", "?x=1,z", F.when(n % 11 == 0, '"').otherwise(""))
    urls = text("https://leetcode.com/problems/p", "$page_id", "/ nonsense")
    texts = t("pages").select(n.alias("id"), F.when(n % 3 == 0, json).when(n % 3 == 1, csv).otherwise(urls).alias("text"))
    spark = texts.sparkSession
    accounts = spark.createDataFrame([("leetcode",), ("codechef",)], "platform string")
    solved = t("pages").filter("page_id % 5 = 0").select(text("leetcode:p", "$page_id").alias("key"))
    rows, _ = imports.previewed(texts, accounts, solved, spark.createDataFrame([], "key string, title string, difficulty string"))
    return rows.select("id", F.col("row").cast("int").alias("row"), "state", "key", "title", "reason")


@R.add("s24_import_faults", f"SELECT page_id AS id, '{imports.UNCLOSED}' AS fault FROM pages WHERE page_id % 2 = 0")
def s24_faults(t):
    n = F.col("page_id")
    texts = t("pages").select(n.alias("id"), F.when(n % 2 == 0, text("url,title\n\"https://x/", "$page_id", ",y")).otherwise(text("url,title\nhttps://x/", "$page_id", ",y")).alias("text"))
    return imports.read_imports(texts)[1].select("id", "fault")


@R.add("s16_flight_profiles", """SELECT c_custkey AS id, CASE WHEN c_custkey % 6 < 4 THEN c_custkey % 90 END AS total, CASE WHEN c_custkey % 6 < 4 THEN c_custkey % 10 END AS easy, CASE c_custkey % 6 WHEN 4 THEN 'another profile' WHEN 5 THEN 'no totals' END AS fault FROM customer""")
def s16_profiles(t):
    """A profile a customer, its JSON cut into two chunks; some belong to others, in some the name stands in a text only."""
    n, quote = F.col("c_custkey"), lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    real = text('1:["$",{"children":[{"dsaProgress":{"byPlatform":{"TUF":{"platform":"TUF","solved":', (n % 90).cast("string"), ',"categories":[{"label":"Easy","solved":', (n % 10).cast("string"), "}]}}}}]}]")
    line = F.when(n % 6 == 5, F.lit('1:{"text":"\\"dsaProgress\\":{\\"byPlatform\\":{}}","solved":3}')).otherwise(real)
    half = F.floor(F.length(line) / 2).cast("int")
    chunk = lambda x: text("<script>self.__next_f.push([1,\"", quote(x), '"])</script>')
    html = text('<link rel="canonical" href="', flight.PROFILE, F.when(n % 6 == 4, "someone").otherwise(text("u", "$c_custkey")), '"/>', chunk(F.substr(line, F.lit(1), half)), chunk(F.substr(line, half + 1)))
    out = flight.flight_profiles(t("customer").select(n.alias("id"), text("u", "$c_custkey").alias("handle"), html.alias("html")))
    return out.select("id", "total", F.get(F.transform("levels", lambda x: x["solved"]), F.lit(0)).alias("easy"), "fault")


@R.add("s23_platform_contents", """SELECT page_id AS id, CASE page_id % 7 WHEN 0 THEN 'T' || page_id || ' says ' || page_id || ' inner' WHEN 1 THEN 'T' || page_id || ' Given ' || page_id || ' <more>' WHEN 2 THEN 'page ' || page_id || ' deep end' WHEN 3 THEN 'T' || page_id || ' body ' || page_id || ' x'
WHEN 4 THEN 'Problem Statement ' || page_id || ' Output n' WHEN 5 THEN 'T' || page_id || ' Find ' || page_id ELSE 'T' || page_id || ' one ' || page_id || ' two n' END AS content FROM pages""")
def s23_contents(t):
    """A problem page a row, in the way of one of seven platforms."""
    n = F.col("page_id")
    pages = [
        ("codeforces", ['<div class="problem-statement"><div class="header"><div class="title">T', "$page_id", '</div><div class="time-limit">1 s</div></div><div>says ', "$page_id", ' <div>inner</div></div><div class="note">no</div></div>']),
        ("leetcode", ['<a href="/problems/p', "$page_id", '/">T', "$page_id", '</a><div data-track-load="description_content"><div>Given ', "$page_id", "</div> &lt;more&gt;</div><div>no</div>"]),
        ("codechef", ['<div id="problem-statement">page ', "$page_id", " <div>deep</div> end</div>no"]),
        ("code360", ["<title>T", "$page_id", '</title><div class="a problem-b">body ', "$page_id", " <div>x</div></div>no"]),
        ("atcoder", ['<div id="task-statement"><span class="lang-ja">no</span><span class="lang-en"><section><h3>Problem Statement</h3> ', "$page_id", "</section><section><h3>Sample</h3>no</section><section><h3>Output</h3> n</section></span></div>"]),
        ("geeksforgeeks", ['<script id="__NEXT_DATA__">{"a":[{"b":{"problem_name":"T', "$page_id", '","problem_question":"<p>Find ', "$page_id", '</p>"}}]}</script>']),
        ("tuf", ["<h1>T", "$page_id", "</h1><main><p>one ", "$page_id", "</p><li>two</li></main><div data-constraints><ul><li>n</li></ul></div><p>no</p>"]),
    ]
    html = platform = None
    for k, (name, parts) in enumerate(pages):
        html = F.when(n % 7 == k, text(*parts)) if html is None else html.when(n % 7 == k, text(*parts))
        platform = F.when(n % 7 == k, name) if platform is None else platform.when(n % 7 == k, name)
    return page_contents(t("pages").select(n.alias("id"), platform.alias("platform"), html.alias("html")))


def captured_profiles(t):
    """A profile answer a customer: some not found, some no JSON; calendars of this year and of one before."""
    n = F.col("c_custkey")
    second = (19_400 * 86_400 + n * 3_600).cast("string")
    calendar = text('{\\"', second, '\\":', (n % 5).cast("string"), ',\\"', (19_400 * 86_400 + n * 3_600 + 60).cast("string"), '\\":3}')
    records = text('[{"id":"1","title":"A","titleSlug":"p', "$c_custkey", '","timestamp":"1700000000"},{"id":"1","title":"B","titleSlug":"p', "$c_custkey", '","timestamp":"1700000060"},{"id":"2","title":"C","titleSlug":"","timestamp":"5"}]')
    user = text('{"username":"u","submitStatsGlobal":{"acSubmissionNum":[{"difficulty":"All","count":', (n % 90).cast("string"), '}]},"userCalendar":{"activeYears":[2020,2022],"submissionCalendar":"', calendar, '"}}')
    body = text('{"data":{"matchedUser":', F.when(n % 9 == 0, "null").otherwise(user), ',"recentAcSubmissionList":', records, F.when(n % 10 == 0, "").otherwise("}}"))
    customers = cut(spread(t("customer").select("c_custkey")))  # answers are made and read by as many tasks as there are cores, whatever the file's row groups; kept, as filters would move below the exchange and take the work along
    answers = customers.select(n.alias("account"), body.alias("body"))
    older = customers.select(n.alias("account"), (F.lit(2020) + n % 3).cast("int").alias("year"), text('{"', (18_900 * 86_400 + n).cast("string"), '":7}').alias("body"))
    return profiles.graph_profiles(answers, older, 2023)


@R.add("s07_profile_totals", f"SELECT c_custkey AS account, CASE WHEN c_custkey % 10 > 0 AND c_custkey % 9 > 0 THEN c_custkey % 90 END AS total, CASE WHEN c_custkey % 10 = 0 THEN '{profiles.UNAVAILABLE}' WHEN c_custkey % 9 = 0 THEN '{profiles.NOT_FOUND}' END AS fault FROM customer")
def s07_totals(t):
    return captured_profiles(t).totals.select("account", "total", "fault")


@R.add("s07_profile_recent", "SELECT c_custkey AS account, '1' AS id, 'leetcode:p' || c_custkey AS key, 'B' AS title, TIMESTAMP '2023-11-14 22:14:20' AS ts FROM customer WHERE c_custkey % 10 > 0 AND c_custkey % 9 > 0")
def s07_recent(t):
    return captured_profiles(t).recent.select("account", "id", "key", "title", "ts")


@R.add("s07_profile_days", """WITH e AS (SELECT c_custkey AS account, 19400 * 86400 + c_custkey * 3600 AS s, c_custkey % 5 AS n FROM customer UNION ALL SELECT c_custkey, 19400 * 86400 + c_custkey * 3600 + 60, 3 FROM customer UNION ALL SELECT c_custkey, 18900 * 86400 + c_custkey, 7 FROM customer WHERE c_custkey % 3 = 2)
SELECT account, CAST(make_timestamp(CAST(s AS BIGINT) * 1000000) AS DATE) AS day, arg_max(n, s) AS n FROM e WHERE n > 0 AND account % 10 > 0 AND account % 9 > 0 GROUP BY 1, 2""")
def s07_days(t):
    return captured_profiles(t).calendar
