import json
from datetime import date, datetime

from tallyspark.sources import profiles

DAY = 86_400


def answer(user="me", recent=(), calendar="{}", years=(), history=(), **more):
    matched = {"username": user, "profile": {"ranking": 7}, "submitStatsGlobal": {"acSubmissionNum": [{"difficulty": "All", "count": 9}, {"difficulty": "Easy", "count": 4}]}, "badges": [{"name": "b"}], "userCalendar": {"activeYears": list(years), "submissionCalendar": calendar}}
    return json.dumps({"data": {"matchedUser": {**matched, **more}, "recentAcSubmissionList": list(recent), "userContestRanking": {"rating": 1500.5}, "userContestRankingHistory": list(history)}})


def test_graph_profiles(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    row = lambda i, slug, s, title="T": {"id": i, "title": title, "titleSlug": slug, "timestamp": s}
    recent = [row("1", "two-sum", "1700000000"), row("2", "a b", "1700000100"), row("1", "two-sum", "1700000500", "Later"), row("", "x", "1"), row("3", "", "1"), row("4", "y", "no"), row("5", "z", "0")]
    calendar = json.dumps({str(19_000 * DAY): 3, str(19_000 * DAY + 60): 5, str(19_001 * DAY): 0, "bad": 2})
    history = [{"attended": True, "rating": 1400.0, "contest": {"title": "C1", "startTime": 1_600_000_000}}, {"attended": False, "rating": 1.0, "contest": {"title": "C2", "startTime": 1}}]
    rows = [("a", answer(recent=recent, calendar=calendar, years=[2019, 2021, 2022, 2023], history=history)), ("b", json.dumps({"data": {"matchedUser": None}})), ("c", json.dumps({"errors": [{"message": "slow down"}]})), ("d", "<html>"), ("e", None)]
    older = [("a", 2021, json.dumps({str(18_700 * DAY): 2})), ("a", 2020, json.dumps({str(18_300 * DAY): 2})), ("a", 2019, json.dumps({str(17_900 * DAY): 2})), ("b", 2022, json.dumps({str(18_900 * DAY): 2}))]
    own = [("a", "2", "Own", "a b", "1700000200"), ("a", "9", "New", "new", "1700000300"), ("b", "1", "no", "no", "5")]
    p = profiles.graph_profiles(spark.createDataFrame(rows, "account string, body string"), spark.createDataFrame(older, "account string, year int, body string"), 2023, spark.createDataFrame(own, "account string, id string, title string, titleSlug string, timestamp string"))
    totals = {r.account: r for r in p.totals.collect()}
    assert (totals["a"].total, totals["a"].breakdown, totals["a"].rank, totals["a"].rating, totals["a"].badges, totals["a"].calendar_available, totals["a"].fault) == (9, {"All": 9, "Easy": 4}, 7, 1500.5, ["b"], True, None)
    assert {k: (r.total, r.fault) for k, r in totals.items() if k != "a"} == {"b": (None, profiles.NOT_FOUND), "c": (None, "slow down"), "d": (None, profiles.UNAVAILABLE), "e": (None, profiles.UNAVAILABLE)}
    assert sorted((r.account, r.id, r.title, r.url, r.ts) for r in p.recent.collect()) == [
        ("a", "1", "Later", "https://leetcode.com/problems/two-sum/", datetime(2023, 11, 14, 22, 21, 40)), ("a", "2", "Own", "https://leetcode.com/problems/a%20b/", datetime(2023, 11, 14, 22, 16, 40)), ("a", "9", "New", "https://leetcode.com/problems/new/", datetime(2023, 11, 14, 22, 18, 20)),
    ]
    assert sorted((r.day, r.n) for r in p.calendar.collect()) == [(date(2021, 3, 14), 2), (date(2022, 1, 8), 5)]
    assert [(r.account, r.ts, r.rating, r.title) for r in p.ratings.collect()] == [("a", datetime(2020, 9, 13, 12, 26, 40), 1400.0, "C1")]


def test_level_profiles(spark):
    body = {"data": {"dsa_domain_data": {"problem_count_data": {"total_count": 12, "difficulty_data": [{"level": "Easy", "count": 5}, {"level": "Hard"}]}}}}
    rows = [("a", json.dumps(body)), ("b", json.dumps({"data": {}})), ("c", None)]
    got = {r.account: (r.total, r.breakdown, r.fault) for r in profiles.level_profiles(spark.createDataFrame(rows, "account string, body string")).collect()}
    assert got == {"a": (12, {"Easy": 5, "Hard": 0}, None), "b": (None, None, profiles.UNAVAILABLE), "c": (None, None, profiles.UNAVAILABLE)}
