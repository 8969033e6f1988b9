"""Coverage, health, evaluation: counts that always carry their denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ratio

LEAST_VERIFIED = 0.5
STALE_DAYS = 30


def health(fields: DataFrame, key: str, blocked: Column | None = None) -> DataFrame:
    """(key, n_fields, verified, stale, unconfirmed, conflicts, verified_share, status, rule): the first rule that
    holds decides. fields: key, status, age_days, tier; blocked: whether the entity has a blocked source."""
    has = F.col("status").isin("verified", "divergent")
    n = lambda c: F.count_if(c)
    g = fields.groupBy(key).agg(
        F.count("*").alias("n_fields"), n(F.col("status") == "verified").alias("verified"), n(has & (F.col("age_days") > STALE_DAYS)).alias("stale"),
        n((F.col("status") == "verified") & (F.col("tier") >= 3)).alias("unconfirmed"), n(F.col("status") == "divergent").alias("conflicts"),
        F.max(F.coalesce(blocked, F.lit(False)).cast("int") if blocked is not None else F.lit(0)).alias("_b"),
    )
    g = g.withColumn("verified_share", ratio(F.col("verified"), F.col("n_fields")))
    rules = [
        ("no_fields", "INSUFFICIENT", F.col("n_fields") == 0), ("few_verified", "INSUFFICIENT", F.col("verified") < LEAST_VERIFIED * F.col("n_fields")),
        ("has_conflict", "REVIEW", F.col("conflicts") > 0), ("has_stale", "REVIEW", F.col("stale") > 0), ("has_blocked_source", "REVIEW", F.col("_b") > 0), ("has_unconfirmed", "REVIEW", F.col("unconfirmed") > 0),
    ]
    return first_rule(g, rules, ("nothing_open", "OK")).drop("_b")


def worst_first(judged: DataFrame, label: str, order: list[str] = ["INSUFFICIENT", "REVIEW", "OK"]) -> DataFrame:  # noqa: B006
    """judged in the order of what needs care: by status as listed, unlisted ones last, then by label."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return judged.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), label)


def first_rule(df: DataFrame, rules: list[tuple[str, str, Column]], otherwise: tuple[str, str]) -> DataFrame:
    """df with rule and status of the first of the ordered rules (name, status, condition) that holds."""
    name = status = None
    for n, s, cond in rules:
        name = F.when(cond, n) if name is None else name.when(cond, n)
        status = F.when(cond, s) if status is None else status.when(cond, s)
    return df.withColumn("status", status.otherwise(otherwise[1])).withColumn("rule", name.otherwise(otherwise[0]))


def confusion(rows: DataFrame, expected: str, got: str, *by: str) -> DataFrame:
    """(by, n, agree, tp, fp, fn, accuracy, precision, recall) of 0 and 1; rows without either don't count."""
    e, g = F.col(expected), F.col(got)
    s = rows.where(e.isNotNull() & g.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(e == g).alias("agree"), F.count_if((e == 1) & (g == 1)).alias("tp"), F.count_if((e == 0) & (g == 1)).alias("fp"), F.count_if((e == 1) & (g == 0)).alias("fn"))
    return s.withColumn("accuracy", ratio(F.col("agree"), F.col("n"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def pooled(rows: DataFrame, part: str, whole: str) -> DataFrame:
    """One ratio of sums, never a mean of ratios."""
    return rows.agg(F.sum(part).cast("bigint").alias("part"), F.sum(whole).cast("bigint").alias("whole")).withColumn("ratio", ratio(F.col("part"), F.col("whole")))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics (metric, value, n) against thresholds (metric, least, inviolable): passed, or null with nothing measured."""
    return metrics.join(thresholds, "metric").withColumn("passed", F.when((F.col("n") > 0) & F.col("value").isNotNull(), F.col("value") >= F.col("least")))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_values, gap): largest less smallest; null below two numbers."""
    g = rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    return g.withColumn("gap", F.when(F.col("n_values") >= 2, F.round(F.col("_hi") - F.col("_lo"), 2))).drop("_hi", "_lo")


def outcome_counts(sessions: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """Sessions by outcome with the share won of those closed, null below 20."""
    n = lambda s: F.count_if(F.col(outcome) == s).alias(s)
    g = sessions.groupBy(*by).agg(F.count("*").alias("n"), n("won"), n("lost"), n("open"))
    closed = F.col("won") + F.col("lost")
    return g.withColumn("closed", closed).withColumn("won_pct", F.when(closed >= 20, F.round(100 * F.col("won") / closed, 1)))
