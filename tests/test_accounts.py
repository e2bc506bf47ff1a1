"""Account state, import jobs and lists, on small tables."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark.operators import accounts as A

now = lambda: F.lit("2024-05-01 12:00:00").cast("timestamp")
at = lambda s: dt.datetime(2024, 5, 1, 12, 0, 0) + dt.timedelta(seconds=s)


def connected(spark):
    return spark.createDataFrame([("p", "Ann", "g1", "idle", None), ("q", "bob", "g2", "idle", None)], "platform string, handle string, generation string, status string, error string")


def test_job_states(spark):
    rows = [("a", "j", "g", "running", 0, 0, 0, 0, None), ("b", "j", "g", "running", 0, 0, 0, 0, None), ("c", "j", "g", "cancelled", 0, 0, 0, 0, None), ("d", "j", "g", "running", 5, 1, 2, 0, None), ("e", "j", "g", "running", 0, 0, 0, 0, None)]
    jobs = spark.createDataFrame(rows, "platform string, job_id string, generation string, status string, cursor long, pages long, accepted long, skipped long, error string")
    kind = "platform string, job_id string, generation string, cursor long, accepted long, skipped long, complete boolean, warning string, code string, n int"
    pages = [("a", "j", "g", 10 * n, 2, 1, n == 3, None, None, n) for n in range(1, 6)] + [("b", "j", "old", 9, 1, 0, True, None, None, 1), ("c", "j", "g", 9, 1, 0, True, None, None, 1), ("d", "j", "g", 9, 1, 0, True, None, "CODE360_TAB_CLOSED", 1), ("d", "j", "g", 19, 1, 0, True, None, None, 2), ("e", "j", "g", 4, 1, 0, False, "late", None, 1)]
    got = {r.platform: (r.status, r.cursor, r.pages, r.accepted, r.skipped, r.error) for r in A.wake(jobs, spark.createDataFrame(pages, kind)).collect()}
    assert got == {"a": ("complete", 30, 3, 6, 3, None), "b": ("running", 0, 0, 0, 0, None), "c": ("cancelled", 0, 0, 0, 0, None), "d": ("waiting-tab", 5, 1, 2, 0, None), "e": ("error", 4, 1, 1, 0, "late")}


def test_bulk_import_is_all_or_nothing(spark):
    records = spark.createDataFrame([("p", "k", "one", 1), ("p", "k", "two", 2), ("q", "m", "x", 3)], "platform string, key string, title string, pos int")
    good = spark.createDataFrame([("p", "g1"), ("q", "g2")], "platform string, generation string")
    assert {(r.platform, r.key, r.title) for r in A.imported(records, connected(spark), good).collect()} == {("p", "k", "two"), ("q", "m", "x")}
    with pytest.raises(PySparkException, match="Preview the import again"):
        A.imported(records, connected(spark), good.filter("platform = 'p'")).collect()


def test_disconnect_and_reconnect(spark):
    accounts = connected(spark).withColumn("snapshot", F.concat("platform", F.lit("-data")))
    left, archive = A.disconnect(accounts, accounts.limit(0), accounts.filter("platform = 'p'").select("platform"))
    asked = spark.createDataFrame([("p", "Ann", "g9"), ("q", "bob", "g8"), ("r", "new", "g7")], "platform string, handle string, generation string")
    got = {r.platform: (r.generation, r.snapshot) for r in A.connect(left, archive, asked).collect()}
    assert got == {"p": ("g9", "p-data"), "q": ("g2", "q-data"), "r": ("g7", None)}
    other = spark.createDataFrame([("q", "someone", "g5")], "platform string, handle string, generation string")
    assert {(r.platform, r.handle, r.snapshot) for r in A.connect(accounts, archive, other).collect()} == {("p", "Ann", "p-data"), ("q", "someone", None)}


def test_browser_events(spark):
    rows = [("p", "ANN", "g1", "7", "two-sum", "Two Sum", at(0)), ("p", "ann", "g1", "7", "two-sum", "Two Sum", at(5)), ("p", "ann", "g0", "8", "a", "A", at(0)), ("p", "ann", "g1", "9x", "a", "A", at(0)), ("p", "ann", "g1", "10", "a", "A", at(-301)), ("p", "ann", "g1", "11", "a", " ", at(0)), ("p", "ann", "g1", "12", "old", "Old", at(0))]
    events = spark.createDataFrame(rows, "platform string, handle string, generation string, id string, slug string, title string, ts timestamp")
    recent = spark.createDataFrame([("p", "p:12")], "platform string, id string")
    got = A.accepted_events(events, connected(spark), recent, now()).collect()
    assert [(r.id, r.key, r.ts, r.pending, r.source) for r in got] == [("p:7", "p:two-sum", at(0), True, "browser")]
    seen = spark.createDataFrame([("p", "ann", "g1", "k", "k", "solved"), ("p", "ann", "g1", "k", "other", "solved"), ("q", "bob", "g2", "m", "m", "clicked")], "platform string, handle string, generation string, key string, page_key string, evidence string")
    assert [(r.key, r.ts, r.source) for r in A.observed_pages(seen, connected(spark), now()).collect()] == [("k", None, "page")]


def test_snapshots(spark):
    kind = "platform string, id string, key string, ts timestamp, pending boolean, source string"
    saved = spark.createDataFrame([("p", "1", "a", at(1), True, "browser"), ("p", "2", "b", at(2), None, None)], kind)
    new = spark.createDataFrame([("p", "1", "a", at(1), True, None), ("p", "3", "c", at(3), False, None)], kind)
    got = sorted((r.id, r.pending, r.source, r.partial) for r in A.merged_snapshot(saved, new, 2).collect())
    assert got == [("2", False, "provider", True), ("3", False, "provider", True)]
    kind = "platform string, key string, id string, ts timestamp, source string"
    saved = spark.createDataFrame([("p", "a", "1", at(5), "s"), ("p", "b", "1", None, "page")], kind)
    new = spark.createDataFrame([("p", "a", "2", at(5), "s"), ("p", "a", "3", at(4), "s"), ("p", "b", "9", at(1), "s")], kind)
    assert sorted((r.key, r.id) for r in A.merged_solved(saved, new).collect()) == [("a", "2"), ("b", "9")]


def test_lists_and_settings(spark):
    lists = spark.createDataFrame([("saved", "Starred"), ("a", "Graphs")], "id string, name string")
    work = spark.createDataFrame([("k", "p", "K", ["saved", "a"], at(0))], "key string, platform string, title string, list_ids array<string>, updated_at timestamp")
    entry = lambda ids: spark.createDataFrame([("k", "p", "K", ids), ("n", "p", "N", [])], "key string, platform string, title string, list_ids array<string>")
    assert {r.key: list(r.list_ids) for r in A.list_membership(work, lists, entry(["a", "a"]), True, now()).collect()} == {"k": ["a", "saved"], "n": []}
    with pytest.raises(PySparkException, match="List not found"):
        A.list_membership(work, lists, entry(["gone"])).collect()
    with pytest.raises(PySparkException, match="Use the star"):
        A.list_membership(work, lists, entry(["saved"]), True).collect()
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert sorted(r.name for r in A.created_lists(lists, names(" Trees "), "s").collect()) == ["Graphs", "Starred", "Trees"]
    for wrong in (names("graphs"), names("x", "X"), names(" "), names("y" * 81)):
        with pytest.raises(PySparkException):
            A.created_lists(lists, wrong, "s").collect()
    saved = spark.createDataFrame([("threshold", "0.4")], "name string, value string")
    rules = {"threshold": F.col("value").cast("double").between(0.1, 1)}
    change = lambda n, v: A.settings(saved, spark.createDataFrame([(n, v)], "name string, value string"), rules).collect()
    assert [tuple(r) for r in change("threshold", "0.5")] == [("threshold", "0.5")]
    for wrong in (("threshold", "7"), ("other", "1")):
        with pytest.raises(PySparkException, match="Invalid setting"):
            change(*wrong)
    known = spark.createDataFrame([("p",), ("q",)], "platform string")
    order = lambda *x: A.platform_order(spark.createDataFrame(list(enumerate(x)), "place int, platform string"), known)
    assert order("q", "p").count() == 2
    for wrong in (("p",), ("p", "p", "q"), ("p", "q", "z")):
        with pytest.raises(PySparkException, match="Invalid platform order"):
            order(*wrong).collect()


def test_daily_status_and_claims(spark):
    kind = "platform string, handle string, day string, done boolean"
    saved, new = spark.createDataFrame([("p", "Ann", "d1", True), ("p", "ann", "d2", False)], kind), spark.createDataFrame([("p", "ann", "d1", False), ("p", "ANN", "d2", True)], kind)
    assert {(r.day, r.done) for r in A.daily_status(saved, new).collect()} == {("d1", True), ("d2", True)}
    tried = spark.createDataFrame([("a", None), ("b", at(-60)), ("c", at(-59))], "platform string, attempted_at timestamp")
    free = A.claimed(tried, now())
    assert {r.platform for r in free.collect()} == {"a", "b"} and A.claimed(free, now()).count() == 0
    asked = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 1, 3)], "platform string, at int, id int")
    assert [(r.platform, r.id) for r in A.single_flight(asked, tried.filter("platform = 'b'")).collect()] == [("a", 2)]


def test_restored_accounts(spark):
    accounts = connected(spark).withColumn("job_id", F.when(F.col("platform") == "p", "j")).withColumn("job_status", F.lit("running"))
    one, two = (sorted(A.restored(accounts, s).collect()) for s in ("x", "y"))
    assert one == sorted(A.restored(accounts, "x").collect())
    assert {r.generation for r in one}.isdisjoint({r.generation for r in two}) and [(r.job_status, r.job_id is None) for r in one] == [("paused", False), (None, True)]


def test_matches(spark):
    versions = spark.createDataFrame([("a1", "A", None), ("a2", "A", "base"), ("a3", "A", "big"), ("b1", "B", None), ("c1", "C", None)], "id string, question_id string, contract string")
    asked = spark.createDataFrame([("a1",)], "asked_id string")
    reviewed = spark.createDataFrame([("A", "B"), ("A", "B")], "question_id string, other_id string")
    hits = spark.createDataFrame([("a1", "A", 9.0), ("a1", "B", 8.0), ("a1", "C", 1.0), ("a1", "D", 2.0)], "asked_id string, question_id string, score double")
    got = sorted((r.relationship, r.question_id, r.version or "", r.place or 0) for r in A.matches(versions, asked, reviewed, hits, 2).collect())
    assert got == [("equivalent", "A", "a2", 0), ("platform-variant", "A", "a3", 0), ("related-suggestion", "D", "", 2), ("variant", "B", "", 1)]
