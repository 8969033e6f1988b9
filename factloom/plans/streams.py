"""Queries of event-time monitoring, each the batch twin of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import monitor
from .registry import query, table

_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return monitor.window_counts(table(spark, sf_dir, "events"), "1 day", by=["event_type"]).withColumn("window_start", _at("window_start"))


@query(f"""WITH s AS (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - to_hours(6 * i) FOR i IN [0, 1, 2, 3]]) AS w, value FROM events)
SELECT {_AT.format("w")} AS window_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s GROUP BY 1""")
def sliding_counts(spark, sf_dir):
    return monitor.window_counts(table(spark, sf_dir, "events"), "24 hours", "6 hours").withColumn("window_start", _at("window_start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return monitor.session_windows(table(spark, sf_dir, "events"), "user_id", "6 hours").withColumn("session_start", _at("session_start")).withColumn("session_end", _at("session_end"))


_HOURS = "h AS (SELECT date_trunc('hour', ts) AS w, count(*) FILTER (event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY 1)"


def _hours(spark, sf_dir):
    return monitor.error_ratio(table(spark, sf_dir, "events"), F.col("event_type") == "error", "1 hour")


@query(f"WITH {_HOURS} SELECT {_AT.format('w')} AS window_start, failed, n, round(failed / CAST(n AS DOUBLE), 4) AS share FROM h WHERE failed / CAST(n AS DOUBLE) >= 0.3")
def error_ratio_alert(spark, sf_dir):
    return _hours(spark, sf_dir).where(F.col("failed") / F.col("n") >= 0.3).withColumn("window_start", _at("window_start"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(quantile_cont(value, 0.95), 4) AS p FROM events GROUP BY 1")
def p95_window(spark, sf_dir):
    return monitor.percentile_windows(table(spark, sf_dir, "events"), "1 day", 0.95).withColumn("window_start", _at("window_start"))


@query(f"""WITH {_HOURS}, c AS (SELECT w, row_number() OVER (ORDER BY w) AS k FROM h WHERE failed / CAST(n AS DOUBLE) >= 0.2), g AS (SELECT epoch(w) - k * 3600 AS g, min(w) AS a, max(w) AS b, count(*) AS n FROM c GROUP BY 1)
SELECT {_AT.format('a')} AS held_from, {_AT.format('b')} AS last_window, n AS n_windows FROM g WHERE n * 3600 >= 7200""")
def threshold_hold(spark, sf_dir):
    """One row for each window enters the single ordered scan, not one for each event."""
    h = monitor.held(_hours(spark, sf_dir), F.col("failed") / F.col("n") >= 0.2, 7200, 3600)
    return h.select(_at("held_from").alias("held_from"), _at("last_window").alias("last_window"), "n_windows")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS quiet_from, strftime(nx, '%Y-%m-%d %H:%M:%S') AS quiet_to, CAST((epoch_us(nx) - epoch_us(ts)) // 1000000 AS BIGINT) AS seconds FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) WHERE epoch_us(nx) - epoch_us(ts) > 172800000000""")
def liveness_gaps(spark, sf_dir):
    g = monitor.silences(table(spark, sf_dir, "events"), "user_id", 172800)
    return g.select("user_id", _at("quiet_from").alias("quiet_from"), _at("quiet_to").alias("quiet_to"), F.col("seconds").cast("bigint").alias("seconds"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 5")
def rate_limit_violations(spark, sf_dir):
    return monitor.over_limit(table(spark, sf_dir, "events"), "user_id", "1 day", 5).withColumn("window_start", _at("window_start"))


@query("SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedup_within_window(spark, sf_dir):
    return monitor.once_a_day(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type", F.col("day").cast("string").alias("day"))


@query("SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS place FROM conversations c WHERE c.conv_id % 2 = 1 OR c.turn > c.conv_id % 3")
def ordered_tail(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    seen = c.where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("seen", F.col("conv_id") % 3)
    return monitor.tail(c, seen, "conv_id", "turn").select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("place"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 250) AS le_250 FROM events GROUP BY 1")
def label_counters_histogram(spark, sf_dir):
    return monitor.histogram(table(spark, sf_dir, "events"), [10, 50, 250], ["event_type"])


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
