import json
import os
from datetime import datetime

from tallyspark.sources.readers import company_snapshot, corpus, pages, solved_csv, url_list
from tallyspark.streaming import state


def feed(folder):
    folder.mkdir()
    rows = [("a", str(i), f"k{i % 4}", f"2024-01-0{1 + i % 5}T10:00:00Z") for i in range(20)]
    for n in range(4):
        own = rows[n * 4 : n * 4 + 8]  # pages overlap
        (folder / f"page{n}.json").write_text("\n".join(json.dumps({"platform": p, "id": i, "key": k, "ts": ts}) for p, i, k, ts in own))
    return rows


def test_upserts_and_replay(spark, tmp_path):
    rows = feed(tmp_path / "feed")
    stream = pages(spark, str(tmp_path / "feed"), per_batch=1)
    state.keep_upserted(stream, str(tmp_path / "table"), str(tmp_path / "ck"), ["platform", "key"], ["ts", "id"]).awaitTermination()
    kept = {r.key: r.id for r in state.Versions(spark, str(tmp_path / "table")).read().collect()}
    assert kept == {k: max(((ts, i) for _, i, kk, ts in rows if kk == k))[1] for k in {r[2] for r in rows}}
    again = state.Versions(spark, str(tmp_path / "table"))
    n = again.latest()
    again.upsert(spark.createDataFrame([("a", "x", "k0", "t", "u", datetime(2030, 1, 1))], "platform string, id string, key string, title string, url string, ts timestamp"), ["platform", "key"], ["ts", "id"], n)
    assert again.latest() == n


def test_replayed_rows_are_dropped(spark, tmp_path):
    rows = feed(tmp_path / "feed")
    q = state.replayed(pages(spark, str(tmp_path / "feed"))).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(int(r.id) for r in spark.table("replayed").collect()) == sorted(int(r[1]) for r in rows)


def test_stateful_merge(spark, tmp_path):
    rows = feed(tmp_path / "feed")
    q = state.merge_stream(pages(spark, str(tmp_path / "feed"), per_batch=1)).writeStream.format("memory").outputMode("update").queryName("merged").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got: dict = {}
    for r in spark.table("merged").collect():
        got[r.key] = max(got.get(r.key, datetime.min), r.ts)
    want = {k: max(datetime.fromisoformat(ts[:-1]) for _, _, kk, ts in rows if kk == k) for k in {r[2] for r in rows}}
    assert got == want


def test_readers(spark, tmp_path):
    (tmp_path / "lc.json").write_text(json.dumps([{"id": "1", "title": "T", "url": "u", "topics": ["A"]}]))
    got = corpus(spark, {"leetcode": str(tmp_path / "lc.json"), "gone": str(tmp_path / "gone.json")}).collect()
    assert [(r.platform, r.title, r.topics) for r in got] == [("leetcode", "T", ["A"])]
    (tmp_path / "c" / "acme").mkdir(parents=True)
    (tmp_path / "c" / "acme" / "30d.csv").write_text("URL,Frequency\nhttps://leetcode.com/problems/two-sum/,87.5%\n")
    r = company_snapshot(spark, str(tmp_path / "c")).first()
    assert (r.company, r.window, r.slug, r.frequency) == ("acme", "30d", "two-sum", 87.5)
    (tmp_path / "s.csv").write_text('url,title\r\n" https://x ","a ""b"", c\nd"\r\n')
    r = solved_csv(spark, str(tmp_path / "s.csv"), ["url", "title"]).first()
    assert r.title == 'a "b", c\nd' and r.url.strip() == "https://x"
    (tmp_path / "u.txt").write_text("https://a https://b\n\nhttps://c")
    assert url_list(spark, str(tmp_path / "u.txt")).count() == 3


def test_throttled_events(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    seconds = [[("a", 0), ("a", 2), ("b", 1), ("a", 3)], [("a", 5), ("a", 6), ("b", 2)]]
    for n, rows in enumerate(seconds):
        (tmp_path / f"feed/page{n}.json").write_text("\n".join(json.dumps({"key": k, "ts": f"2024-01-01T00:00:{s:02d}Z"}) for k, s in rows))
        os.utime(tmp_path / f"feed/page{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in order of time
    source = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "feed"))
    q = state.throttled(source, 3).writeStream.format("memory").outputMode("update").queryName("throttled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.key, r.ts.second) for r in spark.table("throttled").collect()) == [("a", 0), ("a", 3), ("a", 6), ("b", 1)]


def test_cancelled_requests(spark):
    import threading
    import time

    failed = []

    def search():
        with state.cancellable(spark, "request-1"):
            try:
                spark.range(100_000_000_000).selectExpr("sum(sqrt(id))").collect()
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    running = threading.Thread(target=search)
    running.start()
    for _ in range(100):
        time.sleep(0.2)
        state.cancel(spark, "request-0")
        if spark.sparkContext.statusTracker().getActiveJobsIds():
            break
    assert not failed
    state.cancel(spark, "request-1")
    running.join(30)
    assert len(failed) == 1 and spark.range(3).count() == 3
