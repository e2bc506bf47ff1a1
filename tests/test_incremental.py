"""Paged feeds against plain versions that read a page after another; publishing; numbering."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark.operators import ordering
from tallyspark.sources import incremental as I
from tallyspark.sources import manifest

NOW = 40 * 86_400


def plain_walk(rows, start, steps, size):
    """One account's pages, as a provider serves them."""
    out, at = [], start
    for _ in range(steps):
        page = sorted(r for r in rows if r[1] >= at)[:0] or sorted((r for r in rows if r[1] >= at), key=lambda r: (r[1], r[0]))[:size]
        out += page
        last = max([at, *(r[1] for r in page)])
        if len(page) < size:
            return out, last, True, False
        if last == at:
            return out, at, False, True
        at = last
    return out, at, False, False


def plain_sync(rows, state, size):
    cursor, recent, whole, recent_whole = state
    start = max(0, (recent if recent is not None else NOW - 7 * 86_400) - (0 if recent is not None and recent_whole is False else 86_400))
    new, at, complete, stalled = plain_walk(rows, start, 5, size)
    warned = stalled
    if not whole:
        old, cursor, whole, stalled = plain_walk(rows, cursor or 0, 5, size)
        new, warned = new + old, warned or stalled
    return {r[0] for r in new if r[2] == "AC"}, (cursor, max(at, NOW - 86_400) if complete else at, whole, complete), warned


@pytest.mark.parametrize("seed", [0, 1])
def test_syncs_against_plain_version(spark, seed):
    rng = random.Random(seed)
    feeds = {a: [(i + 1, rng.choice([rng.randrange(NOW), NOW - rng.randrange(9 * 86_400), 1000 * rng.randrange(40)]), rng.choice(["AC", "WA"])) for i in range(n)] for a, n in (("none", 0), ("few", 3), ("some", 40), ("many", 130))}
    feeds["stall"] = [(i + 1, 777, "AC") for i in range(20)]
    feed = spark.createDataFrame([(a, *r, f"k{r[0]}") for a, rows in feeds.items() for r in rows], "account string, id long, epoch long, result string, key string")
    states = {a: (None, None, False, None) for a in feeds}
    kind = "account string, cursor long, recent_cursor long, history_complete boolean, recent_complete boolean"
    for _ in range(3):
        table = spark.createDataFrame([(a, *s) for a, s in states.items()], kind)
        records, after = I.synced(table, feed, NOW, size=8)
        got_ids = {}
        for r in records.collect():
            got_ids.setdefault(r.account, set()).add(r.id)
        got = {r.account: r for r in after.collect()}
        for a, rows in feeds.items():
            ids, states[a], warned = plain_sync(rows, states[a], 8)
            r = got[a]
            assert got_ids.get(a, set()) == ids and (r.cursor, r.recent_cursor, r.history_complete, r.recent_complete) == states[a] and (r.warning is not None) == warned
    assert states["few"][2] and not states["stall"][2]


def test_reading_stops(spark):
    pages = [("a", p, 100 - 10 * p - i) for p in range(4) for i in range(10)] + [("b", 0, 5)] + [("c", p, 1000 - 10 * p - i) for p in range(3) for i in range(10)]
    known = spark.createDataFrame([("a", 85, False)], "account string, latest long, whole boolean")
    rows, told = I.newest_pages(spark.createDataFrame(pages, "account string, page int, id long"), known, 10, 2)
    assert {r.account: r.n for r in rows.groupBy("account").agg(F.count("*").alias("n")).collect()} == {"a": 20, "b": 1, "c": 20}
    assert {r.account: (r.pages, r.complete) for r in told.collect()} == {"a": (2, False), "b": (1, True), "c": (2, False)}


def test_history_pages(spark):
    feed = spark.createDataFrame([("a", i, "Me", i) for i in range(5)] + [("b", 9, "me", 1)], "account string, pos int, author string, id int")
    jobs = lambda *x: spark.createDataFrame(list(x), "account string, handle string, offset int")
    rows, after = I.history_pages(jobs(("a", "me", 3)), feed, 2)
    assert sorted(r.pos for r in rows.collect()) == [3, 4] and [tuple(r) for r in after.collect()] == [("a", 5, False)]
    assert I.history_pages(jobs(("a", "me", 5)), feed, 2)[1].first().complete
    with pytest.raises(PySparkException, match="did not match"):
        I.history_pages(jobs(("a", "you", 0)), feed, 2)[0].collect()
    with pytest.raises(PySparkException, match="stalled"):
        I.history_pages(jobs(("b", "me", 0)), feed, 2)[1].collect()


def test_profiles_and_daily_problems(spark):
    raw = spark.createDataFrame([("a", json.dumps({"total": 3, "by": {"easy": 1}}))], "account string, body string")
    assert tuple(I.profiles(raw, "total long, by struct<easy: long>", ["total"]).select("account", "total", "by.easy").first()) == ("a", 3, 1)
    with pytest.raises(PySparkException, match="without total"):
        I.profiles(spark.createDataFrame([("a", "{}")], "account string, body string"), "total long", ["total"]).collect()
    html = '<script>push([1,"{\\"deep\\":{\\"total'  # cut within a name and between chunks
    html += '\\":"])</script><script>push([1, "42}}\\n{\\"other\\":7}"])</script>'
    df = spark.createDataFrame([(html,)], "html string").select(I.embedded(F.col("html"), "push").alias("x")).select(F.size("x"), I.field(F.col("x"), "total"), I.field(F.col("x"), "other"), I.field(F.col("x"), "gone"))
    assert tuple(df.first()) == (2, 42, 7, None)
    rows = [("leetcode", "d", "https://leetcode.com/problems/x/"), ("leetcode", "c", "https://leetcode.com/problems/x/"), ("leetcode", "d", "https://leetcode.com.evil/problems/x/"), ("geeksforgeeks", "d", "https://www.geeksforgeeks.org/problems/x-1/1"), ("other", "d", "https://leetcode.com/problems/x/")]
    got = I.daily_problems(spark.createDataFrame(rows, "platform string, day string, url string"), F.lit("d"))
    assert sorted(r.platform for r in got.collect()) == ["geeksforgeeks", "leetcode"]


def test_years_are_replaced_whole(spark):
    kind = "account string, year int, day int"
    saved, new = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3)], kind), spark.createDataFrame([("a", 1, 9)], kind)
    assert sorted(map(tuple, I.yearly(saved, new).collect())) == [("a", 1, 9), ("a", 2, 3)]


def test_publish_and_sinks(spark, tmp_path):
    a, b = spark.range(10).withColumnRenamed("id", "n"), spark.createDataFrame([("x|y", None)], "t string, u int")
    for _ in range(2):  # a second build replaces the first
        done = manifest.publish({"a": a, "b": b}, str(tmp_path / "out"))
    assert {r.table for r in done.collect()} == {"a", "b"} and all(len(r.sha256) == 64 and r.bytes > 0 for r in done.collect())
    assert spark.read.parquet(str(tmp_path / "out/a")).count() == 10 and not [x for x in os.listdir(tmp_path / "out") if x.startswith(".stage")]
    assert manifest.report("T", {"A": b, "N": a}, 3) == "# T\n\n## A\n\n| t | u |\n| --- | --- |\n| x\\|y |  |\n\n## N\n\n| n |\n| --- |\n| 0 |\n| 1 |\n| 2 |\n\n10 rows in all.\n"
    for rows in (a, a.limit(3)):
        manifest.json_sink(rows, str(tmp_path / "json"), ["n"])
        assert spark.read.json(str(tmp_path / "json")).count() == rows.count()
    assert manifest.optional(spark, str(tmp_path / "json"), "n long").count() == 3 and manifest.optional(spark, str(tmp_path / "gone"), "n long").count() == 0
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="bad.json"):
        manifest.optional(spark, str(tmp_path / "bad.json"), "n long").collect()


def test_numbering(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r.a, r.b): r.rn for r in ordering.numbered(df, [F.desc("a"), F.asc("b")]).collect()}
    want = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert [got[x] for x in want] == list(range(1, 501))
    assert [(r.b, r.rn) for r in ordering.first(df, [F.asc("b")], 3).orderBy("rn").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert ordering.numbered(df.limit(0), [F.asc("a")]).count() == 0


def test_years_are_replaced_in_place(spark, tmp_path):
    folder = str(tmp_path / "calendar")
    schema = "account string, year int, day string, n int"
    put = lambda rows: I.replace_years(spark.createDataFrame(rows, schema), folder)
    put([("a", 2022, "x", 1), ("a", 2023, "y", 2), ("b", 2023, "z", 3), ("a", 2024, "w", 4)])
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "calendar" / "year=2022").iterdir()}
    put([("a", 2023, "new", 5), ("a", 2025, "more", 6)])
    got = sorted((r.account, r.year, r.day, r.n) for r in spark.read.schema(schema).parquet(folder).collect())
    assert got == [("a", 2022, "x", 1), ("a", 2023, "new", 5), ("a", 2024, "w", 4), ("a", 2025, "more", 6), ("b", 2023, "z", 3)]
    assert kept == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "calendar" / "year=2022").iterdir()}


def test_a_walk_keeps_each_page_before_the_next(spark):
    from tallyspark.sources import incremental

    feed = spark.range(40).select((F.col("id") % 2).alias("account"), (F.col("id") + 1).alias("id"), (F.col("id") * 10).alias("epoch"))
    cursors = spark.createDataFrame([(0, 0), (1, 300)], "account long, start long")
    rows, at = incremental.walked(cursors, feed, steps=5, size=4)
    # every page and its window are done with: a plan of all steps at once would hold all their sorts in one task
    assert all("Window" not in df._jdf.queryExecution().toString() for df in (rows, at))
    assert sorted((r.account, r.id) for r in rows.collect()) == sorted([(0, i) for i in range(1, 33, 2)] + [(1, i) for i in range(32, 41, 2)])
    assert {r.account: (r.cursor, r.complete) for r in at.collect()} == {0: (300, False), 1: (390, True)}
