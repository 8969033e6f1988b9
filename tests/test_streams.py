"""Streams give the rows of their batch twins, for windows that are closed."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.streaming import monitor

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


@pytest.fixture
def events(spark, tmp_path):
    """Three files in order of time; the last one only moves the watermark on."""
    rows = [(i, START + dt.timedelta(minutes=7 * i), i % 3, ("view", "error", "click")[i % 3] if i % 11 else "error", float(i)) for i in range(200)]
    end = [(999, START + dt.timedelta(days=30), 9, "view", 1.0)]
    for k, part in enumerate((rows[:120], rows[120:], end)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    return tmp_path


def streamed(spark, events, build, name):
    for k in range(3):
        yield_path = events / "all"
        spark.read.parquet(str(events / f"in{k}")).coalesce(1).write.mode("append").parquet(str(yield_path))
        q = build(spark.readStream.schema(SCHEMA).parquet(str(yield_path))).writeStream.format("parquet").option("path", str(events / name)).option("checkpointLocation", str(events / f"{name}-log")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(events / name))


def batch(spark, events):
    return spark.read.parquet(*[str(events / f"in{k}") for k in range(2)])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("build", [
    lambda e: monitor.window_counts(e, "1 hour", by=["event_type"]),
    lambda e: monitor.window_counts(e, "2 hours", "1 hour"),
    lambda e: monitor.session_windows(e, "user_id", "15 minutes"),
    lambda e: monitor.error_ratio(e, F.col("event_type") == "error", "1 hour"),
    lambda e: monitor.over_limit(e, "user_id", "1 hour", 2),
    lambda e: monitor.bucket_quantile(e, "1 hour", 0.95, [10.0, 50.0, 100.0, 150.0]),
], ids=["tumbling", "sliding", "sessions", "ratio", "limit", "p95"])
def test_stream_is_batch(spark, events, build):
    assert rows(streamed(spark, events, build, "out")) == rows(build(batch(spark, events)))


def test_repeats_within_the_watermark_go(spark, events):
    got = streamed(spark, events, lambda e: monitor.once_within(e, ["user_id"], late="60 days"), "once")
    assert got.count() == 4 == got.select("user_id").distinct().count()


def test_hold(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    w = spark.createDataFrame([("a", at(h)) for h in (0, 1, 2, 5, 6, 9)] + [("b", at(3))], "k string, window_start timestamp")
    held = monitor.held(w, F.lit(True), 7200, 3600, by=["k"]).orderBy("held_from").collect()
    assert [(r["k"], r["held_from"], r["n_windows"]) for r in held] == [("a", at(0), 3), ("a", at(5), 2)]
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    q = monitor.hold_stream(spark.readStream.schema(w.schema).parquet(str(tmp_path / "w")), "k", 3600, 7200).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["k"], r["held_from"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [("a", int(at(0).replace(tzinfo=dt.UTC).timestamp())), ("a", int(at(5).replace(tzinfo=dt.UTC).timestamp()))]


def test_tail(spark):
    t = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "c bigint, n bigint")
    seen = spark.createDataFrame([(1, 0)], "c bigint, seen bigint")
    assert rows(monitor.tail(t, seen, "c", "n")) == [(1, 1), (2, 0)]
