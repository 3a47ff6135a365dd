"""Event, audit and job analytics over the events table (A, F13, R, X47)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.filters import capped_limit, classify_error, cut_text, in_dates, recency, within
from foliant.operators.rows import order_statistics
from foliant.registry import load, query

#: The instant that relative times refer to, explicit so that reruns agree.
AS_OF = "2024-01-31 00:00:00"


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


@query("agent_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS bought, count(DISTINCT event_type) FILTER (value > 10) AS kinds, round(avg(value), 2) AS mean, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), n_if(kind == "error").alias("failed"), n_if(kind == "purchase").alias("bought"), F.countDistinct(F.when(F.col("value") > 10, kind)).alias("kinds"), F.round(F.avg("value"), 2).alias("mean"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("tool_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def tool_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("hourly_failures", "SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def hourly_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(n_if(kind == "purchase").alias("completed"), n_if(kind == "error").alias("failed"))


RATE = f"count(*) AS n, round(count(*) / greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(min(ts))) / 60.0, 1.0), 6) AS per_minute, round(avg(value), 4) AS mean_seconds FROM events"


@query("throughput", f"SELECT coalesce(event_type, 'ingestion') AS task, {RATE} GROUP BY 1 UNION ALL SELECT 'all', {RATE}")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by task and over all, with their rate since the first one."""
    events = load(spark, sf_dir, "events").withColumn("task", F.coalesce("event_type", F.lit("ingestion")))
    minutes = F.greatest((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6, F.lit(1.0))
    out = events.rollup("task").agg(F.count("*").alias("n"), F.round(F.count("*") / minutes, 6).alias("per_minute"), F.round(F.avg("value"), 4).alias("mean_seconds"))
    return out.withColumn("task", F.coalesce("task", F.lit("all")))


@query("top_errors", "SELECT left(props, 200) AS error, event_type AS category, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1, 2 ORDER BY n DESC, error, category LIMIT 10")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten error texts: the limit is the report."""
    grouped = load(spark, sf_dir, "events").groupBy(cut_text(F.col("props"), 200).alias("error"), F.col("event_type").alias("category"))
    return grouped.agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).orderBy(F.desc("n"), "error", "category").limit(capped_limit(10, 50))


@query(
    "rolling_uptime",
    f"""SELECT event_type AS service, {", ".join(f"coalesce(round(100.0 * count(*) FILTER (value > 20 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY) / nullif(count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY), 0), 2), 0) AS up_{d}d" for d in (1, 7, 30))} FROM events GROUP BY 1""",
)
def rolling_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    def share(days: int) -> Column:
        recent = within(F.col("ts").cast("timestamp"), AS_OF, days=days)
        return F.coalesce(F.round(F.try_divide(100.0 * n_if(recent & (F.col("value") > 20)), n_if(recent)), 2), F.lit(0.0)).alias(f"up_{days}d")

    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("service")).agg(*(share(d) for d in (1, 7, 30)))


@query("retention_status", f"SELECT count(*) AS total, min(ts) AS oldest, count(*) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AS expired FROM events")
def retention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = ~within(F.col("ts").cast("timestamp"), AS_OF, days=14)
    return load(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.min("ts").alias("oldest"), n_if(old).alias("expired"))


@query("users_with_errors", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING bool_or(event_type = 'error')")
def users_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    return grouped.filter("bad").drop("bad")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, list_sort(list(value))[least((count(*) * 0.95)::DOUBLE::DECIMAL(18,6)::BIGINT, count(*) - 1) + 1] AS sla95, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1".replace("(count(*) * 0.95)::DOUBLE::DECIMAL(18,6)::BIGINT", "floor(count(*) * 0.95)::BIGINT"))
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear percentiles, the element at int(0.95 n) and the upper median, by ranks that histograms find; no group is sorted or collected."""
    last, n = F.col("n") - 1, F.col("n")
    places = {"p50": 0.5, "p95": 0.95}
    ranks = {f"{name}_{end}": f(last * p) for name, p in places.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = order_statistics(load(spark, sf_dir, "events"), "event_type", "value", {**ranks, "sla95": F.least(F.floor(n * 0.95), last), "upper_median": F.floor(n / 2)})
    linear = [F.round(F.col(f"{name}_low") + (last * p - F.floor(last * p)) * (F.col(f"{name}_high") - F.col(f"{name}_low")), 6).alias(name) for name, p in places.items()]
    return found.select("event_type", *linear, "sla95", "upper_median")


KINDS = ("view", "click", "purchase", "signup", "error")
DIMS_SQL = "value, " + ", ".join(f"(event_type = '{k}')::INT::DOUBLE AS is_{k}" for k in KINDS) + ", (hour(ts) / 24.0)::DOUBLE AS day_part, length(props)::DOUBLE AS size"
DIMS = ["value", *(f"is_{k}" for k in KINDS), "day_part", "size"]


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with seven scores and a length, as messages have them."""
    e = load(spark, sf_dir, "events")
    marks = [(F.col("event_type") == k).cast("int").cast("double").alias(f"is_{k}") for k in KINDS]
    return e.select("event_id", "user_id", "value", *marks, (F.hour("ts") / 24).alias("day_part"), F.length("props").cast("double").alias("size"))


@query("sentiment_baseline", f"WITH d AS (SELECT user_id, {DIMS_SQL} FROM events) SELECT user_id, count(*) AS n, {', '.join(f'round(avg({d}), 4) AS mean_{d}' for d in DIMS)} FROM d GROUP BY 1 HAVING count(*) >= 3")
def sentiment_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's means over seven scores and the length, where there are three messages or more."""
    base = dimensions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), *(F.round(F.avg(d), 4).alias(f"mean_{d}") for d in DIMS))
    return base.filter("n >= 3")


def anomaly(rows: DataFrame, person: str, dims: list[str], least: int = 3) -> DataFrame:
    """rows with `anomaly`: the largest deviation from the person's means, each over max(mean, 0.1), 1 at most; 0 without `least` rows of history."""
    base = rows.groupBy(person).agg(F.count("*").alias("_n"), *(F.avg(d).alias(f"_{d}") for d in dims))
    off = F.array_max(F.array(*(F.abs(F.col(d) - F.col(f"_{d}")) / F.greatest(F.col(f"_{d}"), F.lit(0.1)) for d in dims)))
    out = rows.join(base, person).withColumn("anomaly", F.when(F.col("_n") >= least, F.coalesce(F.least(off, F.when(off.isNotNull(), 1.0)), F.lit(0.0))).otherwise(0.0))
    return out.drop("_n", *(f"_{d}" for d in dims))


OFF = ", ".join(f"abs({d} - m_{d}) / greatest(m_{d}, 0.1)" for d in DIMS)


@query("anomaly_scores", f"WITH d AS (SELECT event_id, user_id, {DIMS_SQL} FROM events), b AS (SELECT user_id, count(*) AS n, {', '.join(f'avg({d}) AS m_{d}' for d in DIMS)} FROM d GROUP BY 1) SELECT event_id, round(CASE WHEN n >= 3 THEN least(greatest({OFF}), 1.0) ELSE 0 END, 6) AS anomaly FROM d JOIN b USING (user_id)")
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly(dimensions(spark, sf_dir), "user_id", DIMS).select("event_id", F.round("anomaly", 6).alias("anomaly"))


@query("token_cost", f"WITH p(event_type, price) AS (VALUES ('view', 0.15), ('click', 0.6), ('purchase', 3.0), ('signup', 15.0), ('error', 0.0)) SELECT event_type AS tier, round(sum(value), 4) AS tokens, round(sum(value) * min(price) / 1000000, 4) AS cost FROM events JOIN p USING (event_type) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("view", 0.15), ("click", 0.6), ("purchase", 3.0), ("signup", 15.0), ("error", 0.0)], "event_type string, price double")
    recent = load(spark, sf_dir, "events").filter(within(F.col("ts").cast("timestamp"), AS_OF, days=30))
    return recent.join(F.broadcast(prices), "event_type").groupBy(F.col("event_type").alias("tier")).agg(F.round(F.sum("value"), 4).alias("tokens"), F.round(F.sum("value") * F.min("price") / 1000000, 4).alias("cost"))


@query("json_predicate", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) >= 50")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return load(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query("date_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive dates; the last day counts whole."""
    return load(spark, sf_dir, "events").filter(in_dates(F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-10")).select("event_id", "ts")


@query("recency_buckets", "SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'This Week' ELSE 'Older' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', ts::DATE, DATE '2024-01-20') AS d FROM events) GROUP BY 1")
def recency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(recency(F.col("ts"), "2024-01-20").alias("bucket")).agg(F.count("*").alias("n"))


@query("error_categories", "SELECT event_type, CASE WHEN event_type = 'error' THEN 'TIMEOUT' WHEN event_type = 'purchase' THEN 'STORAGE' ELSE 'UNKNOWN' END AS category, count(*) AS n FROM events GROUP BY 1, 2")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts made of the events, classified by their words."""
    kind = F.col("event_type")
    message = F.when(kind == "error", F.concat(F.lit("Task TIMED OUT after "), F.col("value"))).when(kind == "purchase", F.lit("S3Error: NoSuchKey")).otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_type", classify_error(message).alias("category")).groupBy("event_type", "category").agg(F.count("*").alias("n"))


def rate_limited(requests: DataFrame, key: str, at: str, most: int, seconds: int) -> DataFrame:
    """requests with `allowed`: at most `most` requests of the key, this one included, in the last `seconds`."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("allowed", F.count("*").over(w) <= most)


@query("rate_limits", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM events")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limited(load(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 3600).select("event_id", "allowed")


def orphans(jobs: DataFrame, as_of: str, minutes: int = 10, tries: int = 2) -> DataFrame:
    """Jobs still pending or processing `minutes` after their last sign, recovered under `tries` times (null: never)."""
    stale = ~within(F.col("updated_at").cast("timestamp"), as_of, mins=minutes)
    return jobs.filter(F.col("status").isin("pending", "processing") & stale & (F.coalesce("recovery_count", F.lit(0)) < tries))


@query("orphan_jobs", f"SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE AND event_id % 3 < 2")
def orphan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "click", "pending").when(kind == "view", "processing").otherwise("complete")
    jobs = load(spark, sf_dir, "events").select("event_id", status.alias("status"), F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("recovery_count"))
    return orphans(jobs, "2024-01-20").select("event_id")


@query("sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")
