"""Change radar: what changed, what it means, whether it matters, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import change_pct, within_pct

#: Below this change in per cent a change is noise.
MATERIAL_PCT = 0.5
RULES_VERSION = "1"
#: Id, kind, weight, least %, below %, band %, least amount, veto.
RULES = [
    ("magnitude_high", "delta", 45.0, 5.0, None, None, None, False),
    ("magnitude_medium", "delta", 25.0, 2.0, 5.0, None, None, False),
    ("magnitude_low", "delta", 10.0, 1.0, 2.0, None, None, False),
    ("table_noise", "delta", 0.0, None, 1.0, None, None, True),
    ("band_entry", "band_entry", 40.0, None, None, 5.0, None, False),
    ("band_exit", "band_exit", 20.0, None, None, 5.0, None, False),
    ("gap_grew", "gap", 20.0, None, None, None, 50.0, False),
    ("heavy_dimension", "dimension", 20.0, None, None, None, None, False),
]
RULE = "rule string, kind string, weight double, min_pct double, max_pct double, band_pct double, min_amount double, veto boolean"
#: Least points of each band, best first.
BANDS = [("HIGH", 45.0), ("MEDIUM", 25.0), ("LOW", 10.0), ("NOISE", 0.0)]


def changes(series: DataFrame, keys: list[str], time: str, value: str, tol_abs: float = 0.0) -> DataFrame:
    """Each row of a series with before, where the value moved by more than the tolerance."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(time))
    return series.withColumn("before", before).where(F.abs(F.col(value) - F.col("before")) > tol_abs)


def impact(rows: DataFrame, before: str, after: str, reference: str, own: Column) -> DataFrame:
    """rows with delta, delta_pct, gap_before, gap_after, direction, material. reference: the home side's price, null
    if there is no pair; own: whether the change is the home side's."""
    delta = F.col(after) - F.col(before)
    pct = change_pct(F.col(before), F.col(after))
    good = F.when(own, delta < 0).otherwise(delta > 0)
    gap = lambda c: F.round(F.col(reference) - F.col(c), 2)
    out = rows.withColumn("delta", F.round(delta, 4)).withColumn("delta_pct", pct).withColumn("gap_before", gap(before)).withColumn("gap_after", gap(after))
    out = out.withColumn("direction", F.when(F.abs(delta) < 1e-9, "neutral").when(good, "favours_home").otherwise("against_home"))
    return out.withColumn("material", F.coalesce(F.abs(pct) >= MATERIAL_PCT, F.lit(False)))


def fires(kind: Column) -> Column:
    """Whether a rule's row fires for an event's row joined to it."""
    c = F.col
    size = F.abs(c("delta_pct"))
    by_size = F.coalesce(size >= c("min_pct"), c("min_pct").isNull()) & F.coalesce(size < c("max_pct"), c("max_pct").isNull()) & size.isNotNull()
    inside = lambda p: within_pct(c(p), c("reference"), c("band_pct"))
    before, after = inside("before"), inside("after")
    wider = (c("gap_after") - c("gap_before")) >= c("min_amount")
    return F.coalesce(
        F.when(kind == "delta", by_size).when(kind == "band_entry", ~before & after).when(kind == "band_exit", before & ~after)
        .when(kind == "gap", wider).when(kind == "dimension", c("heavy")), F.lit(False),
    )


def materiality(events: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """events with points, band, rank, rules_fired, rules_version.

    events: before, after, reference, delta_pct, gap_before, gap_after, heavy. Each event meets each rule of the
    constant table; weights of those that fire add up, a veto makes the event noise.
    """
    met = events.crossJoin(rules).withColumn("_f", fires(F.col("kind")))
    points = F.sum(F.when(F.col("_f"), F.col("weight")).otherwise(0.0))
    fired = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_f"), F.col("rule")))), ",")
    veto = F.max((F.col("_f") & F.col("veto")).cast("int")) == 1
    one = met.groupBy(key).agg(points.alias("points"), fired.alias("rules_fired"), veto.alias("vetoed"))
    band = F.when(F.col("vetoed"), F.lit("NOISE"))
    base = F.when(F.col("vetoed"), F.lit(3000.0))
    for i, (name, least) in enumerate(BANDS):
        band = band.when(F.col("points") >= least, F.lit(name))
        base = base.when(F.col("points") >= least, F.lit(1000.0 * i))
    one = one.withColumn("band", F.coalesce(band, F.lit("NOISE"))).withColumn("rank", (F.coalesce(base, F.lit(3000.0)) + 999 - F.greatest("points", F.lit(0.0))).cast("bigint"))
    return events.join(one.drop("vetoed"), key).withColumn("rules_version", F.lit(RULES_VERSION))


def reactions(band: Column, direction: Column) -> Column:
    """What to do about an event, by its band and direction."""
    return F.when(band == "NOISE", "none").when((band == "HIGH") & (direction == "against_home"), "review_price_today").when(band == "HIGH", "update_argument_today").when(direction == "against_home", "watch").otherwise("note")


def new_and_gone(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two line-ups has, with event appeared or disappeared."""
    a = after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").withColumn("event", F.lit("appeared"))
    return a.unionByName(before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").withColumn("event", F.lit("disappeared")))
