"""Structured Streaming counterparts of the periodic jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.rows import upsert_counts
from foliant.plans.lineage import shared_dir

#: Rows later than this are left out of windows; the raw append table keeps them.
LATE = "10 minutes"


def stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream, `files` of them in a batch at most; times without a zone are taken in the session's."""
    # As a pattern a path may also name one file.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumns({c: raw[c].cast("timestamp") for c, kind in raw.dtypes if kind == "timestamp_ntz"})


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """Completed and failed events by hour, each window once, when the watermark has passed it."""
    kind = F.col("event_type")
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    return windows.agg(F.count(F.when(kind == "purchase", 1)).alias("completed"), F.count(F.when(kind == "error", 1)).alias("failed")).select(F.col("w.start").alias("hour"), "completed", "failed")


def sliding_counts(events: DataFrame, key: str, length: str = "1 hour", slide: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Requests of each key in sliding windows, what a rate limit looks at."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Events without repeats of their keys (a content hash) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


JOB_STATE = "status string, updated_us long, tries int"
JOB_OUT = "job_id long, status string, tries int, at timestamp"
# What each status may become.
NEXT = {"pending": {"processing", "complete", "failed", "dismissed"}, "processing": {"complete", "failed", "dismissed"}, "failed": {"pending", "dismissed"}, "complete": set(), "dismissed": set()}


def follow_job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's status after its events in order; an event that its status doesn't allow is passed over. A job with no sign for ten minutes of
    event time after its last is an orphan: pending again, twice at most, then failed."""
    status, at, tries = state.get if state.exists else ("pending", 0, 0)
    if state.hasTimedOut:
        status, tries = ("pending", tries + 1) if tries < 2 else ("failed", tries)
    else:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for t, new in zip(rows["ts"], rows["status"], strict=True):
            if new in NEXT[status]:
                status = new
            at = max(at, int(t.value // 1000))
    open_ = status in ("pending", "processing")
    state.update((status, at, tries))
    if open_:
        state.setTimeoutTimestamp(max(at // 1000 + 600_000 * (tries + 1), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "tries": [tries], "at": [pd.Timestamp(at, unit="us")]})


def job_states(events: DataFrame, late: str = LATE) -> DataFrame:
    """(job_id, status, tries, at) whenever a job changes; events: job_id, event_id, ts, status."""
    watched = events.withWatermark("ts", late).groupBy("job_id")
    return watched.applyInPandasWithState(follow_job, JOB_OUT, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)


#: Batches after which counters are merged into a base.
COMPACT = 50


def keep_counts(events: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Counters with first and last times by key, upserted batch by batch; read_counts() gives their state.

    A batch writes its own numbered delta only, so one that is run again after a failure writes the same; each COMPACT batches all deltas are merged into a new
    base. Deltas and bases that a later base holds are not read again and may be deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
        new.write.mode("overwrite").parquet(f"{path}/kind=delta/number={number}")
        if number % COMPACT == COMPACT - 1:
            read_counts(batch.sparkSession, keys, path).write.mode("overwrite").parquet(f"{path}/kind=base/number={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """(keys, n, earliest, latest): the last base with the deltas after it."""
    rows = spark.read.parquet(path)
    last = rows.filter("kind = 'base'").agg(F.max("number")).first()[0]
    last = -1 if last is None else last
    deltas, base = rows.filter((F.col("kind") == "delta") & (F.col("number") > last)), rows.filter((F.col("kind") == "base") & (F.col("number") == last))
    return upsert_counts(base, deltas, keys, "n", "earliest", "latest")


def run_all(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through a Parquet sink, as a table (mode append), for batch use and tests."""
    import uuid

    base = f"{shared_dir(out.sparkSession)}/foliant/stream-{name}-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")
