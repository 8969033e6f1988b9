"""Scores: ranges, field and pair scores, weighted fit, cost of use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cents

NEUTRAL = 5.0
#: Relative difference at which a pair's scores stop growing apart.
SATURATES = 0.30
#: A dimension counts when at least this share of its fields is known on both sides.
LEAST_COVERAGE = 0.5
#: Items of a list that give the full score.
FULL_LIST = 7
#: Weights of the first five dimensions in a profile's order.
RANK_WEIGHTS = [35.0, 25.0, 20.0, 12.0, 8.0]


def ranges(facts: DataFrame) -> DataFrame:
    """(field, low, high, n_values, insufficient) of numbers; fewer than two values make no range."""
    g = facts.where("num is not null").groupBy("field").agg(F.min("num").alias("low"), F.max("num").alias("high"), F.count_distinct("num").alias("n_values"))
    return g.withColumn("insufficient", F.col("n_values") < 2)


def scaled(value: Column, low: Column, high: Column, direction: Column) -> Column:
    """0 to 10 between low and high, held at the ends; direction low turns it round."""
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.nullif(high - low, F.lit(0.0))))
    return F.round(10 * F.when(direction == "low", 1 - at).otherwise(at), 2)


def ordinal(value: Column, order: list[str]) -> Column:
    """Place in a list from worst to best, 0 to 10; null outside it."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, F.round((at - 1) * 10 / max(1, len(order) - 1), 2))


def field_score(kind: Column, num: Column, flag: Column, items: Column, low: Column, high: Column, insufficient: Column, direction: Column) -> Column:
    """0 to 10 by the field's kind; neutral where the range says nothing; null without a value."""
    number = F.when(F.coalesce(insufficient, F.lit(True)), F.lit(NEUTRAL)).otherwise(scaled(num, low, high, direction))
    listed = F.round(F.least(F.size(items), F.lit(FULL_LIST)) * 10 / FULL_LIST, 2)
    return F.when((kind == "number") & num.isNotNull(), number).when((kind == "bool") & flag.isNotNull(), F.when(flag, 10.0).otherwise(0.0)).when((kind == "list") & (F.size(items) > 0), listed)


def pair_scores(home: Column, comp: Column, direction: Column) -> Column:
    """struct(home, comp): scores of two numbers without a usable range, apart by their relative difference."""
    largest = F.greatest(F.abs(home), F.abs(comp))
    gap = F.abs(home - comp) / F.nullif(largest, F.lit(0.0))
    reach = 5 * F.least(F.lit(1.0), gap / SATURATES)
    up, down = F.round(NEUTRAL + reach, 2), F.round(NEUTRAL - reach, 2)
    better = F.when(direction == "low", home < comp).otherwise(home > comp)
    even = F.coalesce(gap, F.lit(0.0)) == 0
    return F.struct(F.when(even, NEUTRAL).when(better, up).otherwise(down).alias("home"), F.when(even, NEUTRAL).when(better, down).otherwise(up).alias("comp"))


def weights(ranked: list[str], dimensions: list[str]) -> list[tuple[str, float]]:
    """Each dimension's weight by its place in a profile's order; 0 for those it doesn't name."""
    by = dict(zip(ranked, RANK_WEIGHTS, strict=False))
    return [(d, by.get(d, 0.0)) for d in dimensions]


def field_scores(aligned: DataFrame, field_ranges: DataFrame) -> DataFrame:
    """aligned (see compare.align) with h_score, c_score; a field that one side lacks has neither."""
    r = aligned.join(field_ranges, "field", "left")
    c = F.col
    own = lambda p: field_score(c("kind"), c(p + "num"), c(p + "flag"), c(p + "items"), c("low"), c("high"), c("insufficient"), c("direction"))
    r = r.withColumn("_h", own("h_")).withColumn("_c", own("c_"))
    both = c("_h").isNotNull() & c("_c").isNotNull()
    relative = both & (c("kind") == "number") & F.coalesce("insufficient", F.lit(True))
    pair = pair_scores(c("h_num"), c("c_num"), c("direction"))
    r = r.withColumn("h_score", F.when(relative, pair["home"]).when(both, c("_h"))).withColumn("c_score", F.when(relative, pair["comp"]).when(both, c("_c")))
    return r.drop("_h", "_c")


def dimension_scores(scored: DataFrame, dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dimension, h, c): mean scores of each dimension's fields; those less than half known are left out.

    dimensions: (field, dimension). Sums run over integers of hundredths, so their order doesn't matter."""
    s = scored.join(dimensions, "field").groupBy(*keys, "dimension").agg(
        F.sum(F.col("h_score").cast("decimal(10,2)")).alias("h"), F.sum(F.col("c_score").cast("decimal(10,2)")).alias("c"), F.count("h_score").alias("n"), F.count("*").alias("of"))
    s = s.where((F.col("n") > 0) & (F.col("n") >= LEAST_COVERAGE * F.col("of")))
    mean = lambda x: cents(F.col(x).cast("double") / F.col("n"))
    return s.select(*keys, "dimension", mean("h").alias("h"), mean("c").alias("c"))


def fit(scored: DataFrame, dimensions: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h_fit, c_fit, considered_weight, n_dimensions, h_wins): weighted means over dimension_scores().

    profile: (dimension, weight). A dimension that is left out takes its weight with it."""
    s = dimension_scores(scored, dimensions, keys).join(profile, "dimension", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = F.sum("weight")
    weighted = lambda x: cents(F.sum(cents(F.col(x) * F.col("weight")).cast("decimal(18,2)")).cast("double") / F.nullif(total, F.lit(0.0)))
    return s.groupBy(*keys).agg(weighted("h").alias("h_fit"), weighted("c").alias("c_fit"), total.alias("considered_weight"), F.count("*").alias("n_dimensions"), F.count_if(F.col("h") > F.col("c")).alias("h_wins"))


def fit_changes(before: DataFrame, after: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dimension, weight, h_before, c_before, h_after, c_after): dimensions that both sides have and whose
    scores differ. before, after: see dimension_scores()."""
    side = lambda df, at: df.select(*keys, "dimension", F.col("h").alias(f"h_{at}"), F.col("c").alias(f"c_{at}"))
    j = side(before, "before").join(side(after, "after"), [*keys, "dimension"]).where("h_before <> h_after or c_before <> c_after")
    return j.join(profile, "dimension", "left").select(*keys, "dimension", F.coalesce("weight", F.lit(0.0)).alias("weight"), "h_before", "c_before", "h_after", "c_after")


def cost_of_use(rows: DataFrame, km: Column, per_unit: Column, price: Column) -> DataFrame:
    """rows with cost (km / consumption * price, two digits) or null and lacking, the inputs that are missing."""
    cost = F.round(km / F.nullif(per_unit, F.lit(0.0)) * price, 2)
    lack = F.concat_ws(",", F.when(km.isNull(), "distance"), F.when(per_unit.isNull() | (per_unit == 0), "consumption"), F.when(price.isNull(), "price"))
    return rows.withColumn("cost", cost).withColumn("lacking", lack)
