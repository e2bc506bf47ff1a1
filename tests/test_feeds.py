from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import feeds


def page(spark, html):
    return spark.createDataFrame([(html,)], "html string")


def test_accepted_feed(spark):
    html = """<tr><td>10:05 PM 03/02/24</td><td><a href="/problems/ABC">ABC</a></td><td title='accepted'></td><td><a href="/viewsolution/77">v</a></td></tr>
    <tr><td>12:00 AM 03/02/2024</td><td><a href='/problems/XYZ'>x</a></td><td title="accepted"></td></tr><tr><td>1:00 AM 03/02/24</td><td><a href="/problems/NO">n</a></td><td title="wrong"></td></tr>"""
    got = sorted((r.code, r.id, r.ts) for r in feeds.accepted_feed(page(spark, html)).collect())
    assert got[0] == ("ABC", "77", datetime(2024, 2, 3, 16, 35)) and got[1][2] == datetime(2024, 2, 2, 18, 30) and len(got) == 2


def test_embedded_calendar(spark):
    run = lambda s: {r.day: r["count"] for r in feeds.embedded_calendar(page(spark, f"<script>var userDailySubmissionsStats = {s};</script>")).collect()}
    assert run('[{"date":"2024-1-5","value":3},{"date":"2024-01-05","value":4}]') == {date(2024, 1, 5): 4}
    for bad in ('[{"date":"2024-2-30","value":1}]', '[{"date":"2024-2-3","value":-1}]', '[{"date":"2024-2-3","value":null}]'):
        with pytest.raises(Exception):
            run(bad)


def test_maps_history_profiles(spark):
    df = spark.createDataFrame([('{"Easy":{"1":{"slug":"a","pname":"A","user_subtime":"2024-01-02 10:00"},"2":{"slug":"b"}},"Hard":{}}',)], "json string")
    assert sorted((r.id, r.key, r.title, r.day) for r in feeds.difficulty_map(df).collect()) == [("1", "geeksforgeeks:a", "A", date(2024, 1, 2)), ("2", "geeksforgeeks:b", "b", None)]
    rows = spark.createDataFrame([("/code360/problems/x/", " X ", "2024-01-02T00:00:00Z"), ("https://www.codingninjas.com/studio/problems/x", "X", "2024-01-03T00:00:00+05:30"), ("https://evil/x", "E", None), ("/code360/problems/y", "Y", "2024-01-02 10:00")], "link string, title string, solved_at string")
    got = sorted((r.key, r.ts) for r in feeds.history_page(rows, F.lit("2024-02-01").cast("timestamp")).collect())
    assert got == [("code360:/code360/problems/x", datetime(2024, 1, 2, 18, 30)), ("code360:/code360/problems/y", None)]
    assert feeds.page_fingerprint(rows).first() == feeds.page_fingerprint(rows.orderBy("title")).first()
    r = feeds.profile_table(page(spark, "<tr><th>Rank</th><td>1,234th</td></tr><tr><th> Rating </th><td><img><span>987</span></td></tr>")).first()
    assert (r.rating, r.highest_rating, r["rank"]) == (987, None, 1234)


def test_schedules(spark):
    html = "<div id='contest-table-upcoming'><tr><td><time class='t'>2024-01-06 21:00:00+0900</time></td><td><a href='/contests/abc1'>Round &amp; <b>One</b></a></td><td>02:30</td></tr><tr><td>no</td></tr></div>"
    r = feeds.schedule_table(page(spark, html)).collect()
    assert [(x.slug, x.title, x.end_s - x.start_s) for x in r] == [("abc1", "Round & One", 9000)] and r[0].start_s == 1704542400
    india = spark.createDataFrame([("s", "N", "t", 3, "2024-01-01T05:30:00", "2024-01-01T06:30:00", 0), ("u", "N", "t", 1, "2024-01-01T05:30:00", "2024-01-01T06:30:00", 1)], "slug string, name string, title string, type int, start_time string, end_time string, pos int")
    assert [(x.slug, x.start_s) for x in feeds.schedule_json(india, "india").collect()] == [("s", 1704067200)]


def test_statement_sections(spark):
    by_class = "<div class='problem-statement'><div class='header'>H</div><div>Count <b>all</b> $$x$$<script>no</script></div><div class='input-specification'>n &lt; 5</div><div class='note'>n</div></div><p>after"
    by_head = "<div id='task-statement'><section><h3>Problem Statement</h3><p>Do<br>it</p></section><section><h3>Constraints</h3>1 &le; n</section></div>"
    one = lambda h, how: tuple(page(spark, h).select(feeds.statement_sections(F.col("html"), how).alias("s")).first().s)
    assert one(by_class, "class") == ("Count all x", "n < 5")
    assert one(by_head, "heading") == ("Do it", "1 ≤ n")
    assert one(None, "class") == ("", "")
