import json
import os
import time
from datetime import datetime, timezone

from tallyspark.streaming import timers


def write(folder, n, rows):
    (folder / f"page{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(folder / f"page{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def at(hour, minute=0, day=1):
    return f"2024-01-{day:02d}T{hour:02d}:{minute:02d}:00Z"


def run(spark, folder, name, tmp_path):
    source = spark.readStream.schema("contest string, start timestamp, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    q = timers.reminders(source).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.contest, r.minutes) for r in spark.read.schema(timers.REMINDER).parquet(str(tmp_path / name)).collect())


def test_reminders_fire_once_and_in_time(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    tick = lambda ts: {"contest": "clock", "start": None, "ts": ts}
    write(folder, 0, [{"contest": "a", "start": at(12), "ts": at(8)}, {"contest": "b", "start": at(14), "ts": at(8)}, {"contest": "c", "start": at(9), "ts": at(8, 30)}])
    write(folder, 1, [tick(at(11, 1))])  # a is due in 59 minutes: within the grace
    write(folder, 2, [tick(at(11, 30)), {"contest": "a", "start": at(12), "ts": at(11, 30)}])  # the schedule again: nothing is sent twice
    write(folder, 3, [tick(at(11, 52))])  # ten minutes before a, within the grace
    write(folder, 4, [tick(at(13, 30))])  # after a pause b's first reminder is overdue
    write(folder, 5, [tick(at(13, 51))])
    write(folder, 6, [tick(at(13, 59))])
    got = run(spark, folder, "out", tmp_path)
    assert got == [("a", 10), ("a", 60), ("b", 10)]
    # a restart with more of the feed goes on where it was
    write(folder, 7, [tick(at(14, 30)), {"contest": "d", "start": at(16), "ts": at(14, 30)}])
    write(folder, 8, [tick(at(15, 2))])
    write(folder, 9, [tick(at(15, 3))])
    assert run(spark, folder, "out", tmp_path) == [("a", 10), ("a", 60), ("b", 10), ("d", 60)]


def test_moved_contests_are_due_anew(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    write(folder, 0, [{"contest": "a", "start": at(12), "ts": at(8)}])
    write(folder, 1, [{"contest": "a", "start": at(15), "ts": at(10)}])
    for n, ts in enumerate((at(11, 1), at(11, 51), at(14, 1), at(14, 2), at(14, 51), at(14, 52), at(20, 0, 9), at(20, 1, 9)), 2):
        write(folder, n, [{"contest": "clock", "start": None, "ts": ts}])
    assert run(spark, folder, "moved", tmp_path) == [("a", 10), ("a", 60)]


def test_refreshes_wait_and_keep_the_first(spark, tmp_path):
    folder = tmp_path / "clicks"
    folder.mkdir()
    source = spark.readStream.schema("platform string").json(str(folder))
    q = timers.refreshes(source, (2, 5)).writeStream.format("memory").outputMode("update").queryName("refreshed").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        for n in range(3):
            write(folder, n, [{"platform": "a"}] * 2)
            time.sleep(0.3)
        end = time.time() + 90
        while spark.table("refreshed").count() < 2 and time.time() < end:
            time.sleep(0.5)
        rows = sorted((r.platform, r.attempt, r["at"]) for r in spark.table("refreshed").collect())
        assert [r[:2] for r in rows] == [("a", 1), ("a", 2)]
        assert 2.9 <= (rows[1][2] - rows[0][2]).total_seconds() <= 3.1
        assert rows[0][2] <= datetime.now(timezone.utc).replace(tzinfo=None)
    finally:
        q.stop()
