import json

from tallyspark.sources import schedules

NOW = 1_700_000_000


def event(slug, end, **more):
    return {"slug": slug, "name": slug.upper(), "event_category": "CONTEST", "event_start_time": end - 3600, "event_end_time": end, **more}


def pages(*groups, total=None):
    return [json.dumps({"data": {"events": g, "total_pages": total or len(groups)}}) for g in groups]


def run(spark, rows):
    df = spark.createDataFrame(rows, "platform string, listing string, page int, body string")
    contests, status = schedules.fetched(df, NOW)
    return sorted((r.platform, r.slug) for r in contests.collect()), {r.platform: (r.limited, r.error) for r in status.collect()}


def test_pages_end_where_events_are_over(spark):
    bodies = pages([event("a", NOW + 9), event("x", NOW + 9, event_category="NEWS")], [event("b", NOW + 5), event("c", NOW - 5)], [event("d", NOW - 9)], [event("e", NOW - 99)])
    got, status = run(spark, [("code360", None, i, b) for i, b in enumerate(bodies, 1)])
    assert got == [("code360", s) for s in "abcd"] and status == {"code360": (False, None)}
    many = pages(*([event(f"p{i}", NOW + 9)] for i in range(25)))
    got, status = run(spark, [("code360", None, i, b) for i, b in enumerate(many, 1)])
    assert len(got) == 20 and status == {"code360": (True, None)}


def test_an_unsound_page_fails_its_source_alone(spark):
    first, _ = pages([event("a", NOW + 9)], [event("b", NOW + 9)])
    gfg = [{"results": {"upcoming": [{"type": 3, "slug": "g1", "name": "G", "start_time": "2030-01-01T20:00:00", "end_time": "2030-01-01T22:00:00"}, {"type": 1, "slug": "no"}], "past": []}, "next_upcoming": True}, {"results": {"upcoming": [], "past": []}, "next_upcoming": False}]
    rows = [("code360", None, 1, first), ("code360", None, 2, "<html>down</html>")] + [("geeksforgeeks", None, i, json.dumps(b)) for i, b in enumerate(gfg, 1)]
    got, status = run(spark, rows)
    assert got == [("geeksforgeeks", "g1")] and status == {"code360": (False, schedules.UNAVAILABLE), "geeksforgeeks": (False, None)}


def test_a_removed_listing_falls_back(spark):
    one = lambda slug: {"title": slug, "titleSlug": slug, "startTime": NOW, "duration": 60}
    full, short = json.dumps({"data": {"allContests": [one("a"), one("b"), one("c")]}}), json.dumps({"data": {"topTwoContests": [one("a"), one("b")]}})
    gone = json.dumps({"errors": [{"message": "other"}, {"message": "Cannot query field 'allContests' on type 'Query'."}]})
    assert run(spark, [("leetcode", "allContests", 1, full), ("leetcode", "topTwoContests", 1, short)]) == ([("leetcode", s) for s in "abc"], {"leetcode": (False, None)})
    assert run(spark, [("leetcode", "allContests", 1, gone), ("leetcode", "topTwoContests", 1, short)]) == ([("leetcode", s) for s in "ab"], {"leetcode": (True, None)})
    broken = json.dumps({"errors": [{"message": "server error"}]})
    assert run(spark, [("leetcode", "allContests", 1, broken), ("leetcode", "topTwoContests", 1, short)]) == ([], {"leetcode": (False, schedules.UNAVAILABLE)})


def test_refresh_keeps_what_failed(spark):
    schema = "platform string, slug string, title string, start_s long, end_s long"
    saved = spark.createDataFrame([("a", "past", "t", 1, NOW - 1), ("a", "cancelled", "t", 1, NOW + 1), ("a", "moved", "t", 1, NOW + 2), ("b", "coming", "t", 1, NOW + 1), ("c", "unasked", "t", 1, NOW + 1)], schema)
    new = spark.createDataFrame([("a", "moved", "t2", 5, NOW + 9)], schema)
    status = spark.createDataFrame([("a", False, None), ("b", False, schedules.UNAVAILABLE)], "platform string, limited boolean, error string")
    got = sorted((r.platform, r.slug, r.start_s) for r in schedules.refreshed(saved, new, status, NOW).collect())
    assert got == [("a", "moved", 5), ("a", "past", 1), ("b", "coming", 1), ("c", "unasked", 1)]
