"""Stateful processors with timers: rolling health of services, first and last sightings, tracked jobs.

They need the RocksDB state store; start queries within rocksdb(spark). Times go in and out of them as microseconds, so that no time zone matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.streaming.jobs import LATE, NEXT

HOUR_MS = 3_600_000
#: Checks older than this go.
KEEP_DAYS = 31
#: A job without a sign for so long is an orphan; it is tried again so many times.
ORPHAN_MS, MOST_TRIES = 600_000, 2


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Health(StatefulProcessor):
    """For each service its checks of the last `days` days by hour: hours leave when the watermark is so far beyond their end, by a timer on the oldest."""

    OUT = "service string, as_of long, n long, n_ok long, latency_ms long, hours int"

    def __init__(self, days: int = KEEP_DAYS) -> None:
        self.keep = days * 24 * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "n long, n_ok long, latency_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ok = pdf["ok"].fillna(False).astype(bool)
            part = pd.DataFrame({"hour": pdf["us"] // (HOUR_MS * 1000), "n": 1, "ok": ok.astype("int64"), "ms": pdf["latency_ms"].fillna(0).astype("int64")})
            for hour, new in part.groupby("hour").sum().iterrows():
                at = (int(hour),)
                old = self.hours.getValue(at) if self.hours.containsKey(at) else (0, 0, 0)
                self.hours.updateValue(at, (old[0] + int(new["n"]), old[1] + int(new["ok"]), old[2] + int(new["ms"])))
        yield self.summary(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self.summary(key, timerValues.getCurrentWatermarkInMs())

    def summary(self, key: Any, watermark: int) -> pd.DataFrame:
        held = {k[0]: tuple(v) for k, v in self.hours.iterator()}
        for hour in [h for h in held if (h + 1) * HOUR_MS + self.keep <= watermark]:
            self.hours.removeKey((hour,))
            del held[hour]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer((min(held) + 1) * HOUR_MS + self.keep)
        total = [sum(v[i] for v in held.values()) for i in range(3)]
        return pd.DataFrame({"service": [key[0]], "as_of": [max(watermark, 0) * 1000], "n": [total[0]], "n_ok": [total[1]], "latency_ms": [total[2]], "hours": [len(held)]})

    def close(self) -> None:
        pass


def health(checks: DataFrame, days: int = KEEP_DAYS, late: str = LATE) -> DataFrame:
    """Checks (service, checked_at, ok, latency_ms) to sums over the checks that are kept, a row for each service with each batch that it is in and whenever checks leave.

    A service's last row holds: the one of the greatest as_of (the watermark), of those the one of the most checks. Checks later than the watermark are left out.
    """
    rows = checks.withColumn("us", F.unix_micros("checked_at")).withWatermark("checked_at", late)
    out = rows.groupBy("service").transformWithStateInPandas(Health(days), Health.OUT, "Append", "EventTime")
    return out.withColumn("as_of", F.timestamp_micros("as_of"))


class Sightings(StatefulProcessor):
    """How often a key was seen, when first and when last."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "n long, first_us long, last_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, first, last = self.state.get() if self.state.exists() else (0, 2**62, -(2**62))
        for pdf in rows:
            if len(pdf):
                n, first, last = n + len(pdf), min(first, int(pdf["us"].min())), max(last, int(pdf["us"].max()))
        self.state.update((n, first, last))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "first_seen": [first], "last_seen": [last]})

    def close(self) -> None:
        pass


def sightings(events: DataFrame, key: str) -> DataFrame:
    """(key, n, first_seen, last_seen) of each key whenever a batch has it; the row of the largest n holds. No row is too late. Rows without a time are left out."""
    out = f"{key} {events.schema[key].dataType.simpleString()}, n long, first_seen long, last_seen long"
    rows = events.filter("ts IS NOT NULL").select(key, F.unix_micros("ts").alias("us"))
    found = rows.groupBy(key).transformWithStateInPandas(Sightings(key), out, "Append", "None")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


class Jobs(StatefulProcessor):
    """A job's status after its events in order. A timer looks after open jobs: one without a sign for ten minutes of event time goes back to pending, twice at
    most, then it fails. Jobs that are done leave the state `days` days after their last sign."""

    OUT = "job_id long, step int, status string, tries int, at long, reason string"

    def __init__(self, days: int = KEEP_DAYS) -> None:
        self.keep = days * 24 * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at_us long, tries int, step int")

    def look_again(self, at_ms: int, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at_ms, watermark + 1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", "event_id"])
        status, at, tries, step = self.job.get() if self.job.exists() else ("pending", 0, 0, 0)
        for t, to in zip(new["us"], new["status"], strict=True):
            if to in NEXT[status]:
                status = to
            at = max(at, int(t))
        step += 1
        self.job.update((status, at, tries, step))
        open_ = status in ("pending", "processing")
        self.look_again(at // 1000 + (ORPHAN_MS if open_ else self.keep), timerValues.getCurrentWatermarkInMs())
        yield self.row(key, step, status, tries, at, "events")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, at, tries, step = self.job.get()
        if status not in ("pending", "processing"):
            self.job.clear()
            yield self.row(key, step + 1, status, tries, at, "evicted")
            return
        status, tries = ("pending", tries + 1) if tries < MOST_TRIES else ("failed", tries)
        # The clock of the next try starts when this one was given up.
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self.job.update((status, at, tries, step + 1))
        self.look_again(at // 1000 + (ORPHAN_MS if status == "pending" else self.keep), timerValues.getCurrentWatermarkInMs())
        yield self.row(key, step + 1, status, tries, at, "orphan")

    def row(self, key: Any, step: int, status: str, tries: int, at: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "step": [step], "status": [status], "tries": [tries], "at": [at], "reason": [reason]})

    def close(self) -> None:
        pass


def tracked_jobs(events: DataFrame, days: int = KEEP_DAYS, late: str = LATE) -> DataFrame:
    """Events (job_id, event_id, ts, status) to (job_id, step, status, tries, at, reason) whenever a job changes; the largest step holds.

    Events that the status doesn't allow, or of an unknown status, are passed over but are signs of life. Reasons: events, orphan, evicted (the job left the state).
    """
    rows = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    out = rows.groupBy("job_id").transformWithStateInPandas(Jobs(days), Jobs.OUT, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))
