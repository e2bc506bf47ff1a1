"""Reminders and delayed refreshes as keyed state with timers, on Structured Streaming; both need the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000
# How many minutes before the start reminders are due, how late one may still be sent, how long a sent one is remembered, and after how many seconds a submission is looked up, and again.
OFFSETS = (60, 10)
GRACE = 5 * MINUTE
REMEMBERED = 7 * 24 * 60 * MINUTE
DELAYS = (30, 120)

LONG = T.StructType([T.StructField("v", T.LongType())])
REMINDER = T.StructType([T.StructField(n, t) for n, t in (("contest", T.StringType()), ("minutes", T.IntegerType()), ("sent", T.TimestampType()), ("start", T.TimestampType()))])
REFRESH = T.StructType([T.StructField("platform", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("at", T.TimestampType())])


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Reminders(StatefulProcessor):
    """One contest: its start, the reminders already sent, and a timer for each that is still due.

    A schedule's row sets the start anew, and the timers with it. When the watermark passes a reminder's due time, it is sent if that is at most GRACE ago, the contest hasn't begun and it was not
    sent before; what is overdue after a pause is left out. The sent mark is part of the state that is committed with the batch, so a restarted query sends nothing again. A week after
    the start a last timer drops the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", LONG)
        self.sent = handle.getMapState("sent", T.StructType([T.StructField("minutes", T.IntegerType())]), LONG)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None  # the latest row tells the schedule
        for pdf in rows:
            for seen, start in zip(pdf["ts"], pdf["start"]):
                if start is not None and not pd.isna(start) and (last is None or (_ms(seen), _ms(start)) > last):
                    last = (_ms(seen), _ms(start))
        if last is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.start.update((last[1],))
        now = timerValues.getCurrentWatermarkInMs()
        for minutes in OFFSETS:
            due = last[1] - minutes * MINUTE
            if not self.sent.containsKey((minutes,)) and due + GRACE >= now:
                self.handle.registerTimer(max(due, 1))
        self.handle.registerTimer(last[1] + REMEMBERED)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        start = self.start.get()[0] if self.start.exists() else None
        if start is None or at >= start + REMEMBERED:
            self.start.clear()
            self.sent.clear()
            return
        minutes = (start - at) // MINUTE
        if now - at > GRACE or now >= start or minutes not in OFFSETS or self.sent.containsKey((minutes,)):
            return
        self.sent.updateValue((minutes,), (now,))
        yield pd.DataFrame({"contest": [key[0]], "minutes": [minutes], "sent": [pd.Timestamp(now, unit="ms")], "start": [pd.Timestamp(start, unit="ms")]})

    def close(self) -> None:
        pass


def reminders(schedule: DataFrame, late: str = "0 seconds") -> DataFrame:
    """contest, minutes, sent, start of reminders as they come due. schedule: a stream of contest, start, ts (when it was read); rows of any contest, also without a start, move the clock on."""
    clocked = schedule.select("contest", "start", "ts").withWatermark("ts", late)
    return clocked.groupBy("contest").transformWithStateInPandas(statefulProcessor=Reminders(), outputStructType=REMINDER, outputMode="Append", timeMode="EventTime")


class Debounced(StatefulProcessor):
    """One platform's pending refreshes: the first submission starts a timer for each delay; further ones change nothing until the first timer has fired."""

    def __init__(self, delays: tuple[float, ...]):
        self.delays = [int(d * 1000) for d in delays]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", T.StructType([T.StructField("attempt", T.IntegerType())]), LONG)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(pdf) for pdf in rows)
        if n and not self.pending.containsKey((1,)):
            now = timerValues.getCurrentProcessingTimeInMs()
            for attempt, delay in enumerate(self.delays, 1):
                if self.pending.containsKey((attempt,)):  # a retry of the round before is put off
                    self.handle.deleteTimer(self.pending.getValue((attempt,))[0])
                self.pending.updateValue((attempt,), (now + delay,))
                self.handle.registerTimer(now + delay)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        fired = [k[0] for k, v in self.pending.iterator() if v[0] == at]
        for attempt in fired:
            self.pending.removeKey((attempt,))
        if fired:
            yield pd.DataFrame({"platform": [key[0]] * len(fired), "attempt": fired, "at": [pd.Timestamp(at, unit="ms")] * len(fired)})

    def close(self) -> None:
        pass


def refreshes(submissions: DataFrame, delays: tuple[float, ...] = DELAYS) -> DataFrame:
    """platform, attempt, at: refreshes some seconds after the first of a run of submissions (platform), by processing time. A submission never makes a record by itself."""
    return submissions.select("platform").groupBy("platform").transformWithStateInPandas(statefulProcessor=Debounced(delays), outputStructType=REFRESH, outputMode="Update", timeMode="ProcessingTime")
