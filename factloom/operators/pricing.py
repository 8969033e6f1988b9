"""Codes of a price table for the versions of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .spelling import resolve


def by_trio(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (brand, model, version, ...) with the code that the catalogue stores under just these three; null
    where it stores none. A trio that is stored twice gives its smallest code."""
    one = stored.groupBy("brand", "model", "version").agg(F.min("code").alias("code"))
    return requests.join(one, ["brand", "model", "version"], "left")


def price_codes(requests: DataFrame, seeded: DataFrame, stored: DataFrame, pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, code, origin, score, reason): the code of each version, from the surest place that has one.

    requests: id, brand, model, version. In order: seeded (name, code), by the folded words of model and version;
    stored (brand, model, version, code), by just these three; pages (id, code) saved for the version; listed (brand,
    name, code), the price table's own list of a brand, by near spelling. Equal names with several codes in one place
    give the smallest, but for the list: there the same name under two codes, or two names that fit equally, is
    ambiguous and nothing is chosen. Only what the first three leave open meets the list, and only through near
    words. reason: ambiguous, unknown, or no_list where the brand has none; null with a code."""
    name = fold(F.concat_ws(" ", "model", "version"))
    ours = requests.select("id", "brand", "model", "version", name.alias("_name"))
    seed = seeded.select(fold(F.col("name")).alias("_name"), "code").groupBy("_name").agg(F.min("code").alias("_seeded"))
    saved = pages.groupBy("id").agg(F.min("code").alias("_saved"))
    sure = by_trio(ours, stored).withColumnRenamed("code", "_stored").join(seed, "_name", "left").join(saved, "id", "left")
    sure = sure.withColumn("code", F.coalesce("_seeded", "_stored", "_saved"))
    origin = F.when(F.col("_seeded").isNotNull(), "seeded").when(F.col("_stored").isNotNull(), "stored").when(F.col("_saved").isNotNull(), "page")
    done = sure.where("code is not null").select("id", "code", origin.alias("origin"), F.lit(100.0).alias("score"), F.lit(None).cast("string").alias("reason"))
    left = sure.where("code is null").select("id", "brand", "_name")
    names = listed.select("brand", fold(F.col("name")).alias("name"), "code").groupBy("brand", "name").agg(F.min("code").alias("code"), F.count_distinct("code").alias("_codes"))
    fit = resolve(left, names, "_name", "name", within=["brand"]).select("brand", F.col("query").alias("_name"), "outcome", "name", "score")
    brands = names.select("brand").distinct().withColumn("_has", F.lit(True))
    j = left.join(fit, ["brand", "_name"], "left").join(names, ["brand", "name"], "left").join(brands, "brand", "left")
    found = (F.col("outcome") == "found") & (F.col("_codes") == 1)
    why = F.when(F.col("_has").isNull(), "no_list").when(F.col("_codes") > 1, "ambiguous").otherwise(F.coalesce("outcome", F.lit("unknown")))
    return done.unionByName(j.select("id", F.when(found, F.col("code")).alias("code"), F.when(found, "list").alias("origin"), "score", F.when(~F.coalesce(found, F.lit(False)), why).alias("reason")))
