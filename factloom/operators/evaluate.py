"""Evaluation of facts against expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import close
from ..functions.text import fold, tokens


def compare_text(expected: Column, got: Column) -> Column:
    """'exact' when equal but for case, marks and white space; 'contained' when got has all words of expected, so it
    is the more specific; else 'different'."""
    words = lambda t: tokens(t, [])
    return F.when(fold(expected) == fold(got), "exact").when((F.size(words(expected)) > 0) & (F.size(F.array_except(words(expected), words(got))) == 0), "contained").otherwise("different")


def compare_list(expected: Column, got: Column) -> Column:
    """struct(equal, missing, extra): items match one to one, each once, after folding; what lacks and what is more."""
    items = lambda a: F.array_sort(F.array_distinct(F.transform(a, fold)))
    lack, more = F.array_except(items(expected), items(got)), F.array_except(items(got), items(expected))
    return F.struct(((F.size(lack) == 0) & (F.size(more) == 0)).alias("equal"), lack.alias("missing"), more.alias("extra"))


def compare_any(expected: Column, got: Column, tol_abs: Column, tol_rel: Column) -> Column:
    """Whether a number agrees with any of several expected ones."""
    return F.exists(expected, lambda e: close(e, got, tol_abs, tol_rel))


def flattened(truth: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(entity, field, value): one row for each expected value of a nested or wide row; null values are no target.
    fields: name -> SQL expression on a row."""
    entries = F.array(*[F.struct(F.lit(name).alias("field"), F.expr(e).cast("string").alias("value")) for name, e in fields.items()])
    return truth.select(F.col(id_col).alias("entity"), F.explode(F.filter(entries, lambda x: x["value"].isNotNull())).alias("t")).select("entity", "t.*")


def truth_faults(targets: DataFrame) -> DataFrame:
    """targets (entity, field, value) with fault: 'blank', 'twice' (its entity has the field more than once), else null."""
    n = targets.groupBy("entity", "field").agg(F.count("*").alias("times"))
    return targets.join(n, ["entity", "field"]).withColumn("fault", F.when(F.trim("value") == "", "blank").when(F.col("times") > 1, "twice")).drop("times")


def resolver_accuracy(cases: DataFrame, by: list[str]) -> DataFrame:
    """cases (*by, exists, decided, suggested): right when an existing name was decided, and when another was refused
    with a suggestion."""
    right = F.when(F.col("exists"), F.col("decided")).otherwise(~F.col("decided") & F.col("suggested"))
    return cases.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(~F.col("exists")).alias("negative"))


def divergence_recall(expected: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """How many of the divergences known beforehand (entity, field) the decisions show as such."""
    shown = decided.where("status = 'divergent'").select("entity", "field").distinct().withColumn("shown", F.lit(True))
    return expected.select("entity", *by).distinct().join(shown, ["entity", "field"], "left").groupBy(*by).agg(F.count("*").alias("expected"), F.count("shown").alias("shown"))
