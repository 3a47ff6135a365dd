"""Chunks, mail and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunks import chunk
from foliant.operators.mail import assign_threads
from foliant.operators.rows import first_by
from foliant.registry import load, load_spread, query
from foliant.streaming.jobs import hourly, once, run_all, session_counts, sliding_counts, stream
from foliant.streaming.stateful import health, rocksdb, sightings


@query("document_chunks")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents; tests hold the chunker against its rules."""
    out = chunk(load_spread(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk_index", "section", "token_count", F.sha2("text", 256).alias("text_sha256"))


@query("reply_threads", "SELECT conv_id * 1000 + turn AS doc_id, left(sha256('<' || conv_id || '-' || (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) || '>'), 16) AS thread_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position FROM (SELECT DISTINCT conv_id, turn FROM conversations) c")
def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mails: each turn replies to the one before it, the first has only its own id."""
    from pyspark.sql import Window

    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    name = lambda t: F.concat(F.lit("<"), F.col("conv_id"), F.lit("-"), t, F.lit(">"))
    mails = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), name(F.col("turn")).alias("message_id"), name(before).alias("in_reply_to"), F.lit("").alias("references"), F.lit(None).cast("string").alias("subject"))
    return assign_threads(mails)


@query("stream_hourly", "SELECT hour, completed, failed FROM (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events table read as a stream: every window that the watermark has passed."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return run_all(hourly(stream(spark, path, schema)), "hourly").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_once", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    out = run_all(once(stream(spark, path, spark.read.parquet(path).schema), ["event_id"]), "once")
    return out.agg(F.count("*").alias("n"))


#: A window has been given out when the watermark, ten minutes behind the last event, has reached its end.
CLOSED = '<= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE'


@query("stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE {CLOSED}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events table read as a stream, those that the watermark has closed."""
    path = f"{sf_dir}/events.parquet"
    out = run_all(session_counts(stream(spark, path, spark.read.parquet(path).schema), "user_id"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("started"), F.col("end").cast("timestamp_ntz").alias("ended"), "n")


@query("stream_sliding", f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS start FROM events, range(6) r(i)) SELECT event_type, start, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR {CLOSED} GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type in windows of an hour that slide by ten minutes, of the events table read as a stream."""
    path = f"{sf_dir}/events.parquet"
    out = run_all(sliding_counts(stream(spark, path, spark.read.parquet(path).schema), "event_type"), "sliding")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sightings", "SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, when first and when last each user was seen, kept as state over the events table read as a stream; the last row of each holds."""
    path = f"{sf_dir}/events.parquet"
    with rocksdb(spark):
        out = run_all(sightings(stream(spark, path, spark.read.parquet(path).schema), "user_id"), "sightings")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "first_seen", "last_seen"), "n").alias("x"))
    return last.select("user_id", "x.n", *(F.col(f"x.{c}").cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")))


#: An event is a check of the service that its type names; users stand in for outcomes and latencies. Hours stay while their end is less than a week behind the watermark.
@query("stream_health", """SELECT event_type AS service, count(*) AS n, count(*) FILTER (user_id % 10 <> 0) AS n_ok, sum(user_id % 1000)::BIGINT AS latency_ms, count(DISTINCT date_trunc('hour', ts))::INT AS hours
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE - INTERVAL 7 DAY GROUP BY 1""")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week of checks of each service, kept as state with timers over the events table read as a stream."""
    path = f"{sf_dir}/events.parquet"
    checks = stream(spark, path, spark.read.parquet(path).schema).select(F.col("event_type").alias("service"), F.col("ts").alias("checked_at"), (F.col("user_id") % 10 != 0).alias("ok"), (F.col("user_id") % 1000).cast("long").alias("latency_ms"))
    with rocksdb(spark):
        out = run_all(health(checks, days=7), "health")
    last = first_by(out, ["service"], [F.col("as_of").desc(), F.col("n").desc()])
    return last.filter("n > 0").select("service", "n", "n_ok", "latency_ms", "hours")
