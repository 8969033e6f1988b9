"""Audits: what of a truth set was seen before, and which published values have proof and agree with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import close
from . import ground
from .tables import ratio

#: Results of an audited field, in the order in which they are decided.
RESULTS = ["conflict", "unknown", "no_proof", "not_verified", "correct", "truth_lacking_or_different"]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def mentions(families: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(family, id_col): texts that hold the words of a family's model in order, with nothing but marks, or nothing,
    between them ('F-150' and 'F150' for 'F 150').

    families: family, model. Every run of as many words as a model has, and every shorter one, is written without its
    gaps; runs meet models by equality and the pairs are confirmed in the text. A model without a letter or digit is
    found nowhere. Models are few words; the longest one's number of words bounds the runs."""
    f = families.select("family", _words(F.col("model")).alias("_w")).where(F.size("_w") > 0).distinct()
    f = f.select("family", F.array_join("_w", "").alias("_key"), F.concat(F.lit("(?<![a-z0-9])"), F.array_join("_w", "[^a-z0-9]*"), F.lit("(?![a-z0-9])")).alias("_pattern"), F.size("_w").alias("_n"))
    most = f.agg(F.max("_n").alias("n")).first()["n"] or 0
    run = lambda n: lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), ""))
    runs = lambda w: F.flatten(F.array(*[F.when(F.size(w) >= n, run(n)(w)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]))
    keyed = F.array_distinct(F.get(F.transform(F.array(_words(F.col("_t"))), runs), F.lit(0))) if most else F.array().cast("array<string>")
    t = texts.select(id_col, F.col(text_col).alias("_t"))
    met = t.select(id_col, F.explode(keyed).alias("_key")).join(f, "_key").select(id_col, "family", "_pattern")
    return met.join(t, id_col).where(F.regexp_like(F.lower("_t"), F.col("_pattern"))).select("family", id_col).distinct()


def exposure(families: DataFrame, used: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(family, n_prior, n_mentions, status) of the families of a truth set.

    used: (id, target), subjects that earlier tests aimed at; texts: whatever the engine was built from. A prior target
    proves use; a mention alone asks for a review, and so does silence, which proves nothing."""
    prior = mentions(families, used, "id", "target").groupBy("family").agg(F.count("*").alias("n_prior"))
    said = mentions(families, texts, id_col, text_col).groupBy("family").agg(F.count("*").alias("n_mentions"))
    out = families.select("family").distinct().join(prior, "family", "left").join(said, "family", "left").fillna(0, ["n_prior", "n_mentions"])
    return out.withColumn("status", F.when(F.col("n_prior") > 0, "used_before").otherwise("review_pending"))


def proofs(claims: DataFrame, texts: DataFrame, refused: Column | None = None) -> DataFrame:
    """claims (entity, field, num, quote, source, status, tol_rel) with reason, null where the proof holds.

    texts: (source, text, sha256), one text a source; equal rows count once. The first that fails: text_changed (no text, or another digest), quote_not_found,
    refused (a Column of the caller's own reasons) and number_not_in_quote."""
    j = claims.join(texts.select("source", F.col("text").alias("source_text"), "sha256").distinct(), "source", "left")
    found = ground.locate(j).withColumn("_own", refused if refused is not None else F.lit(None).cast("string"))
    intact = F.coalesce(F.sha2("source_text", 256) == F.col("sha256"), F.lit(False))
    shown = F.coalesce(ground.number_proven(F.col("num"), F.col("quote")), F.lit(False))
    why = F.when(~intact, "text_changed").when(~F.col("mode").isin(ground.EXACT, ground.FOLDED, ground.FUZZY), "quote_not_found").when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("num").isNotNull() & ~shown, "number_not_in_quote")
    return found.withColumn("reason", why).drop("_own", "source_text", "sha256", "mode", "score")


def failures_by_field(proved: DataFrame) -> DataFrame:
    """(field, reason, n): failed proofs, counted."""
    return proved.where("reason is not null").groupBy("field", "reason").agg(F.count("*").alias("n"))


def audited(wanted: DataFrame, proved: DataFrame, truth: DataFrame, tol_rel: float = 0.0) -> DataFrame:
    """(entity, field, n_values, n_valid, matches, result) of every field wanted.

    proved: see proofs(); truth: (entity, field, num). A field whose status is divergent or that has several values is
    a conflict, whatever their proof; one value is correct where some proof holds, it is verified and the truth has it
    too. Fields without a value are unknown; fields beyond `wanted` do not count."""
    g = proved.groupBy("entity", "field").agg(
        F.count("num").alias("n_values"), F.count_if(F.col("num").isNotNull() & F.col("reason").isNull()).alias("n_valid"), F.min("num").alias("_low"), F.max("num").alias("_high"),
        F.coalesce(F.bool_or(F.col("status") == "divergent"), F.lit(False)).alias("_divergent"), F.coalesce(F.bool_and(F.when(F.col("num").isNotNull(), F.coalesce(F.col("status") == "verified", F.lit(False)))), F.lit(False)).alias("_verified"))
    j = wanted.select("entity", "field").distinct().join(g, ["entity", "field"], "left").join(truth.select("entity", "field", F.col("num").alias("_truth")), ["entity", "field"], "left").fillna(0, ["n_values", "n_valid"])
    conflict = F.coalesce(F.col("_divergent") | (F.col("_low") != F.col("_high")), F.lit(False))
    agrees = F.coalesce(close(F.col("_truth"), F.col("_low"), F.lit(0.0), F.lit(tol_rel)), F.lit(False)) & ~conflict
    result = F.when(conflict, "conflict").when(F.col("n_values") == 0, "unknown").when(F.col("n_valid") == 0, "no_proof").when(~F.col("_verified"), "not_verified").when(agrees, "correct").otherwise("truth_lacking_or_different")
    return j.select("entity", "field", "n_values", "n_valid", agrees.alias("matches"), result.alias("result"))


def audit_summary(fields: DataFrame, least: float) -> DataFrame:
    """(entity, wanted, correct, correct_share, conflicts, supported, matches, met): met where at least the share
    `least` of the fields wanted is correct. Only counts over (entity, field) rows, so partial sums do the work."""
    n = lambda c: F.count_if(c)
    g = fields.groupBy("entity").agg(
        F.count("*").alias("wanted"), n(F.col("result") == "correct").alias("correct"), n(F.col("result") == "conflict").alias("conflicts"),
        n(F.col("result").isin("correct", "truth_lacking_or_different")).alias("supported"), n(F.col("matches")).alias("matches"))
    return g.withColumn("correct_share", ratio(F.col("correct"), F.col("wanted"))).withColumn("met", F.col("correct") >= least * F.col("wanted"))


def settled_rate(wanted: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(*by, wanted, settled, rate): the share of the fields wanted that were found; null where none is wanted.

    wanted: (*by, field), field null for a key that wants nothing; found: (*by, field). Repeated rows count once and
    fields that nobody wanted not at all."""
    hit = found.select(*by, "field").distinct().withColumn("_hit", F.lit(1))
    g = wanted.select(*by, "field").distinct().join(hit, [*by, "field"], "left").groupBy(*by).agg(F.count("field").alias("wanted"), F.count("_hit").alias("settled"))
    return g.withColumn("rate", ratio(F.col("settled"), F.col("wanted")))
