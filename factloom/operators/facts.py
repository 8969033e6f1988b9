"""The fact model: entity, field and one typed value, with what each field's values mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import literal

#: Version of the field table; it travels in outputs that depend on the table.
SPEC_VERSION = "1"
SPEC = "field string, grp string, kind string, tol_abs double, tol_rel double, direction string, has_is_better boolean, orderable boolean"
#: States of an empty field: the source says there is none; nobody mentions it; found, but without proof; not asked.
DECLARED_ABSENT, NOT_FOUND, UNVERIFIED = "declared_absent", "not_found", "unverified"
VERIFIED, DIVERGENT = "verified", "divergent"
ABSENT_STATES = [DECLARED_ABSENT, NOT_FOUND, UNVERIFIED]


def spec_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return literal(spark, rows, SPEC)


def blank(num: Column, flag: Column, items: Column, txt: Column) -> Column:
    """Whether a value is missing. False and 0 are values; a blank text and an empty list are not."""
    return num.isNull() & flag.isNull() & (items.isNull() | (F.size(items) == 0)) & (txt.isNull() | (F.trim(txt) == ""))


def long_facts(sheet: DataFrame, key: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """(entity, field, num, flag, items, txt, status) of a wide table. fields: (field, kind, column), kind one of
    number, bool, list, text. Every field gets a row; a missing value has status not_found."""
    kinds = {"number": ("num", "double"), "bool": ("flag", "boolean"), "list": ("items", "array<string>"), "text": ("txt", "string")}

    def one(field: str, kind: str, col: str) -> Column:
        cells = [F.col(col).cast(t).alias(n) if kind == k else F.lit(None).cast(t).alias(n) for k, (n, t) in kinds.items()]
        return F.struct(F.lit(field).alias("field"), *cells)

    long = sheet.select(F.col(key).alias("entity"), F.explode(F.array(*[one(*f) for f in fields])).alias("f")).select("entity", "f.*")
    gone = blank(F.col("num"), F.col("flag"), F.col("items"), F.col("txt"))
    return long.withColumn("status", F.when(gone, F.lit(NOT_FOUND)).otherwise(F.lit(VERIFIED)))


def as_text(num: Column, flag: Column, items: Column, txt: Column) -> Column:
    """A value for reading: numbers with two digits, yes and no, lists joined."""
    number = F.format_string("%.2f", num)
    return F.coalesce(F.when(num.isNotNull(), number), F.when(flag, "yes").when(~flag, "no"), F.when(F.size(items) > 0, F.array_join(items, ", ")), F.nullif(F.trim(txt), F.lit("")))


def requested(facts: DataFrame, fields: list[str]) -> DataFrame:
    """All rows stay; values of fields that were not asked for become null with status unverified."""
    asked = F.col("field").isin(fields)
    out = facts
    for c in ("num", "flag", "items", "txt"):
        out = out.withColumn(c, F.when(asked, F.col(c)))
    return out.withColumn("status", F.when(asked, F.col("status")).otherwise(F.lit(UNVERIFIED)))
