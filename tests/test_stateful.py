"""Stateful processors over several batches and a restart, against plain Python."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.streaming.jobs import stream
from foliant.streaming.stateful import health, rocksdb, sightings, tracked_jobs

START = datetime(2024, 1, 1)


def feed(spark, tmp_path, schema, batches, build):
    """All rows that come out when each batch is one run of the query: each starts anew from the checkpoint of the one before."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        found = build(stream(spark, path, spark.read.parquet(path).schema))
        with rocksdb(spark):
            q = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).collect()


def test_health(spark, tmp_path):
    """Hours leave when the watermark is three days beyond their end; a check later than the watermark is left out; null outcomes failed."""
    at = lambda d, h=0: START + timedelta(days=d, hours=h)
    batches = [
        [("db", at(0), True, 5), ("db", at(0, 1), False, 7), ("web", at(0), None, None), ("db", at(2), True, 1)],
        [("db", at(3, 12), True, 2), ("db", at(0, 2), True, 9)],
        [("web", at(9), True, 4)],
    ]
    rows = feed(spark, tmp_path, "service string, checked_at timestamp, ok boolean, latency_ms long", batches, lambda s: health(s, days=3))
    last = {}
    for r in sorted(rows, key=lambda r: (r.as_of, r.n)):
        last.setdefault(r.service, []).append((r.n, r.n_ok, r.latency_ms, r.hours))
    # The late check (day 0, hour 2) isn't in any row; in the end all of db's checks have left.
    assert (3, 2, 13, 3) in last["db"] and (2, 2, 3, 2) in last["db"] and last["db"][-1] == (0, 0, 0, 0) and max(n for n, *_ in last["db"]) <= 4
    assert last["web"][0] == (1, 0, 0, 1) and last["web"][-1] == (1, 1, 4, 1)


def test_sightings(spark, tmp_path):
    batches = [[("a", START, 1), ("b", START, 1), ("a", START + timedelta(1), 1), (None, START, 1)], [("a", START - timedelta(5), 1), ("b", None, 1)]]
    rows = feed(spark, tmp_path, "who string, ts timestamp, x int", batches, lambda s: sightings(s, "who"))
    last = {}
    for r in sorted(rows, key=lambda r: r.n):
        last[r.who] = (r.n, r.first_seen, r.last_seen)
    assert last == {"a": (3, START - timedelta(5), START + timedelta(1)), "b": (1, START, START), None: (1, START, START)}


def test_jobs(spark, tmp_path):
    """Orphans go back twice and then fail; what is done can't be reopened and leaves the state after its days."""
    at = lambda m: START + timedelta(minutes=m)
    batches = [
        [(1, 1, at(0), "processing"), (1, 2, at(1), "complete"), (1, 3, at(2), "failed"), (2, 4, at(0), "processing"), (3, 5, at(0), "nonsense"), (3, 6, at(3), "failed")],
        [(3, 7, at(4), "pending"), (9, 8, at(30), "pending")],
        [(9, 9, at(45), "complete")],
        [(9, 10, at(60), "complete")],
        [(9, 11, at(60 * 24 * 3), "complete")],
    ]
    rows = feed(spark, tmp_path, "job_id long, event_id long, ts timestamp, status string", batches, lambda s: tracked_jobs(s, days=1))
    seen = {}
    for r in sorted(rows, key=lambda r: (r.job_id, r.step)):
        seen.setdefault(r.job_id, []).append((r.status, r.tries, r.reason))
    assert seen[1] == [("complete", 0, "events"), ("complete", 0, "evicted")]
    assert seen[2][:4] == [("processing", 0, "events"), ("pending", 1, "orphan"), ("pending", 2, "orphan"), ("failed", 2, "orphan")]
    assert seen[2][4:] == [("failed", 2, "evicted")] and seen[3][0] == ("failed", 0, "events") and seen[9][-1][0] == "complete"
