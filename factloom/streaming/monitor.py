"""Event-time monitoring. Each function takes a batch table or a stream alike unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """events with ts as a timestamp; a stream also gets a watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late) if late and e.isStreaming else e


def window_counts(events: DataFrame, size: str, slide: str | None = None, by: list[str] = (), ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n, total): counts and sums of values in tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = timed(events, ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", F.col("total").cast("double").alias("total"))


def session_windows(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): runs of events with less than `gap` between neighbours; the end is the
    last event's time plus the gap."""
    g = timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def error_ratio(events: DataFrame, failed: Column, size: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    g = timed(events, ts, late).groupBy(F.window(ts, size).alias("w")).agg(F.count_if(failed).alias("failed"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "failed", "n", F.round(F.col("failed") / F.col("n"), 4).alias("share"))


def percentile_windows(events: DataFrame, size: str, p: float, by: list[str] = (), ts: str = "ts") -> DataFrame:
    """Batch: (window_start, by, n, p), the exact quantile with values between two ranks interpolated. Equal values of
    a window are counted first, and ranks are running sums of the counts: no aggregate buffers a window's values. A
    stream keeps bucket counts instead, see bucket_quantile."""
    w = F.window(F.col(ts).cast("timestamp"), size)["start"]
    counts = events.groupBy(w.alias("window_start"), *by, "value").agg(F.count("*").alias("c"))
    of = W.partitionBy("window_start", *by)
    c = counts.withColumn("n", F.sum("c").over(of)).withColumn("known", F.sum(F.when(F.col("value").isNotNull(), F.col("c"))).over(of))
    c = c.withColumn("upto", F.sum("c").over(of.orderBy(F.asc_nulls_last("value")))).withColumn("rank", p * (F.col("known") - 1))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("value")))
    g = c.groupBy("window_start", *by, "n", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    return g.select("window_start", *by, "n", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")), 4).alias("p"))


def bucket_quantile(events: DataFrame, size: str, p: float, edges: list[float], by: list[str] = (), ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n, p): a quantile of values in windows from counts of buckets, for batch and stream alike.

    edges: upper ends of the buckets, rising; values above the last one have a bucket without end. Inside the bucket
    that the rank falls into, values are taken to lie evenly, the first one beginning at 0 (at its edge, if that isn't
    above 0); a rank in the bucket without end gives the last edge. The error is at most that bucket's width. A
    window's state is one count for each edge, and counts of parts add up, so no value is kept. Null values and NaN
    count in n and, as the largest, in the rank."""
    n_below = [F.count_if((F.col("value") <= e) & ~F.isnan("value")).alias(f"_le{i}") for i, e in enumerate(edges)]
    g = timed(events, ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), *n_below)
    rank = p * F.col("n")
    out = F.lit(float(edges[-1]))
    for i in reversed(range(len(edges))):
        low = edges[i - 1] if i else min(0.0, edges[0])
        past = F.col(f"_le{i - 1}") if i else F.lit(0)
        inside = low + (edges[i] - low) * (rank - past) / (F.col(f"_le{i}") - past)
        out = F.when((F.col(f"_le{i}") >= rank) & (F.col(f"_le{i}") > past), inside).otherwise(out)
    return g.select(F.col("w.start").alias("window_start"), *by, "n", F.round(out, 4).alias("p"))


def histogram(events: DataFrame, edges: list[float], by: list[str]) -> DataFrame:
    """(by, n, total, le_<edge>...): cumulative buckets of values."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), *[F.count_if(F.col("value") <= e).alias(f"le_{e:g}") for e in edges])


def held(windows: DataFrame, condition: Column, seconds: int, size: int, start: str = "window_start", by: list[str] = ()) -> DataFrame:
    """Batch: stretches of adjoining windows of `size` seconds in which condition holds, at least `seconds` long."""
    at = F.unix_seconds(F.col(start).cast("timestamp"))
    hot = windows.where(condition).withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(start) if by else W.orderBy(start)))
    runs = hot.withColumn("_g", at - F.col("_n") * size).groupBy(*by, "_g").agg(F.min(start).alias("held_from"), F.max(start).alias("last_window"), F.count("*").alias("n_windows"))
    return runs.where(F.col("n_windows") * size >= seconds).drop("_g")


def hold_stream(windows: DataFrame, key: str, size: int, seconds: int, start: str = "window_start") -> DataFrame:
    """Stream: (key, held_from, at) once for each stretch of hot windows that reaches `seconds`; windows arrive in
    order within a key. The state is the stretch now open."""
    need = -(-seconds // size)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        for b in batches:
            for t in sorted(int(x.timestamp()) for x in b[start]):
                first, n = (first, n + 1) if last is not None and t == last + size else (t, 1)
                last = t
                if n == need:
                    out.append((keys[0], first, t))
        state.update((first, last, n))
        yield pd.DataFrame(out, columns=["key", "held_from", "at"])

    done = windows.groupBy(key).applyInPandasWithState(step, "key string, held_from long, at long", "first long, last long, n long", "append", "NoTimeout")
    return done.withColumnRenamed("key", key)


def silences(events: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Batch: (key, quiet_from, quiet_to, seconds): gaps between neighbouring events longer than allowed."""
    nxt = F.lead(ts).over(W.partitionBy(key).orderBy(ts))
    gap = F.unix_micros(F.col("_x").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("_x", nxt).withColumn("_g", gap).where(F.col("_g") > seconds * 1_000_000).select(key, F.col(ts).alias("quiet_from"), F.col("_x").alias("quiet_to"), F.floor(F.col("_g") / 1_000_000).alias("seconds"))


def over_limit(events: DataFrame, key: str, size: str, most: int, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n) where a key has more events in a window than allowed."""
    g = timed(events, ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return g.select(F.col("w.start").alias("window_start"), key, "n")


def once_a_day(events: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batch: the first event of each key and day; others repeat it."""
    day = F.to_date(ts)
    by = W.partitionBy(*keys, "day").orderBy(ts, tie)
    return events.withColumn("day", day).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def once_within(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Stream: an event goes when one with equal keys came within the watermark's reach."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


def tail(trail: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a trail after the last one that a reader has seen; all rows of trails never seen."""
    s = seen.select(F.col(key).alias("_k"), F.col("seen"))
    return trail.join(s, F.col(key) == F.col("_k"), "left").where(F.col("seen").isNull() | (F.col(order) > F.col("seen"))).drop("_k", "seen")
