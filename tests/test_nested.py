import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import backups, nested

URL = "https://leetcode.com/problems/two-sum/"


def question(**more):
    return {"platform": "leetcode", "title": "Two Sum", "url": URL, "key": "leetcode:two-sum", **more}


def backup(**more):
    account = {"handle": "me", "dailyHistory": {"2024-01-02": {"handle": "me", "done": True, "verifiedAt": 5}}, "snapshot": {"recent": [question(timestamp=1.5e12, topics=["Array"])], "solved": {"leetcode:two-sum": question()}, "ratings": [{"timestamp": 1, "rating": 2.5}], "calendar": {"2024-01-01": 3}}}
    base = {"version": 1, "accounts": {"leetcode": account}, "lists": {"saved": {"id": "saved", "name": "Saved"}}, "workspace": {"leetcode:two-sum": question(listIds=["saved"])}, "settings": {"dailyGoal": 3, "timeZone": "Asia/Kolkata", "autoSync": True, "platformOrder": ["codechef"]}}
    return {**base, **more}


def changed(path, value):
    out = json.loads(json.dumps(backup()))
    *way, last = path.split("/")
    node = out
    for step in way:
        node = node[int(step) if step.isdigit() else step]
    node[last] = value
    return out


def deep(n):
    node = 1
    for _ in range(n):
        node = {"x": node}
    return node


CASES = [
    (backup(), []), (backup(disconnectedAccounts={"codechef": {"handle": "chef"}}), []), (backup(version=2), ["version"]), (backup(version="1"), ["version"]), ([1], ["not an object"]), (backup(lists=[]), ["lists", "list ids"]), (changed("settings/dailyGoal", 51), ["daily goal"]),
    (changed("settings/dailyGoal", 2.5), ["daily goal"]), (changed("settings/timeZone", ""), ["time zone"]), (changed("settings/autoSync", 1), ["autoSync"]), (changed("settings/platformOrder", ["nowhere"]), ["platform order"]),
    (changed("accounts/leetcode/handle", "bad handle"), ["daily history", "handle"]), (changed("accounts/elsewhere", {"handle": "x"}), ["account"]), (changed("accounts/leetcode/snapshot/recent", {}), ["recent"]),
    (changed("accounts/leetcode/snapshot/recent/0/key", "leetcode:other"), ["question"]), (changed("accounts/leetcode/snapshot/recent/0/title", 7), ["question"]), (changed("accounts/leetcode/snapshot/recent/0/url", "http://leetcode.com/problems/two-sum/"), ["question"]),
    (changed("accounts/leetcode/snapshot/recent/0/timestamp", "soon"), ["question"]), (changed("accounts/leetcode/snapshot/recent/0/topics", [1]), ["question"]), (changed("accounts/leetcode/snapshot/solved/other", question()), ["question key"]),
    (changed("accounts/leetcode/snapshot/ratings", [{"timestamp": 1}]), ["ratings"]), (changed("accounts/leetcode/snapshot/calendar/2024-01-01", "3"), ["counts"]), (changed("accounts/leetcode/dailyHistory/yesterday", {"handle": "me", "done": True, "verifiedAt": 5}), ["daily history"]),
    (changed("accounts/leetcode/dailyHistory", {date.fromordinal(730_000 + i).isoformat(): {"handle": "me", "done": False, "verifiedAt": 1} for i in range(367)}), ["daily history"]),
    (changed("lists/saved/name", " "), ["list"]), (changed("workspace/leetcode:two-sum/listIds", ["gone"]), ["list ids"]), (changed("settings/__proto__", {}), ["forbidden key"]), (changed("accounts/leetcode/prototype", 1), ["forbidden key"]),
    (changed("settings/more", deep(37)), []), (changed("settings/more", deep(38)), ["too deep"]),
]


def test_backups(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(CASES)] + [(900, "{not json"), (901, None)]
    got = {r.id: r.faults for r in backups.validated(spark.createDataFrame(rows, "id long, text string").repartition(2)).collect()}
    assert {i: sorted(set(got[i])) for i in range(len(CASES))} == {i: sorted(want) for i, (_, want) in enumerate(CASES)}
    assert got[900] == got[901] == ["not an object"]


def test_walk_meets_nodes_in_order(spark):
    docs = [(1, {"a": [{"hit": 1}, {"b": {"hit": 2, "c": {"hit": 3}}}], "text": '"hit": 9'}), (2, {"hit": {"hit": 4}}), (3, [])]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id long, text string").select("id", F.parse_json("text").alias("v"))
    hits = nested.found(df, "id", "v", nested.at(F.col("node"), "$.hit").isNotNull())
    rows = hits.select("id", "place", F.try_variant_get("node", "$.hit", "long").alias("n")).orderBy("id", "place").collect()
    assert [(r.id, r.n) for r in rows] == [(1, 1), (1, 2), (1, 3), (2, None), (2, 4)]
    assert nested.found(df.limit(0), "id", "v", F.lit(True)).count() == 0


@pytest.mark.parametrize("value,want", [('{"a":1}', "OBJECT"), ("[1]", "ARRAY"), ('"x"', "STRING"), ("1", "BIGINT"), ("1.5", "DECIMAL"), ("1e300", "DOUBLE"), ("true", "BOOLEAN"), ("null", "VOID")])
def test_kinds(spark, value, want):
    assert spark.range(1).select(nested.kind(F.parse_json(F.lit(value))).alias("k")).first().k == want
