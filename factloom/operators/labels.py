"""Labelled values of sheets in running text: label and value on lines of their own, in columns, or behind a colon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import is_absent, label, once, split_list
from .extract import columns_of_line, is_table_text, labelled, lines
from .tables import literal

#: Lines below a label in which its value may stand, and the longest label.
REACH, LONGEST = 2, 60
#: Lines that are no value: headings in capitals, questions, bare marks.
NO_VALUE = r"^(?:[^A-Za-z0-9]*|[A-Z ]{12,}|.*\?)$"


def label_map(spark: SparkSession, rows: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """Known labels: (label as label() folds it, field, kind, dimension). One label names one field."""
    return literal(spark, rows, "label string, field string, kind string, dimension string")


def next_line_pairs(docs: DataFrame, known: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, pos, label, value): a line that is a known label, with the first line below it, of REACH, that is not
    blank. Nothing where that line is a label itself or no value, nor in texts laid out as tables. Labels are whole
    lines, since in lists of equipment a label's words begin other items. Rows of docs are worked on alone."""
    is_label = lambda x: (F.length(F.trim(x)) <= LONGEST) & label(x).isin(known)
    below = lambda every, i: F.filter(F.slice(every, i + 2, REACH), lambda x: F.trim(x) != "")
    one = lambda every: F.transform(every, lambda x, i: F.when(is_label(x), F.struct(i.alias("pos"), F.trim(x).alias("label"), F.trim(F.get(below(every, i), F.lit(0))).alias("value"))))
    found = F.array_compact(once(F.split(F.col(text_col), "\n"), one))
    out = docs.where(~F.coalesce(is_table_text(F.col(text_col)), F.lit(False))).select(F.col(id_col), F.explode(found).alias("p")).select(id_col, "p.*")
    return out.where(F.col("value").isNotNull() & ~is_label(F.col("value")) & ~F.col("value").rlike(NO_VALUE))


def column_pairs(docs: DataFrame, known: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, pos, label, value): known labels in the first cell of a line set in columns, with the second cell."""
    cells = lines(docs, text_col, id_col).select(id_col, "pos", columns_of_line(F.col("line")).alias("c")).where(F.size("c") >= 2)
    out = cells.select(id_col, "pos", F.trim(F.get("c", F.lit(0))).alias("label"), F.trim(F.get("c", F.lit(1))).alias("value"))
    return out.where(label(F.col("label")).isin(known))


def colon_pairs(docs: DataFrame, known: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, pos, label, value): known labels before a colon."""
    return labelled(docs, text_col, id_col).where(label(F.col("label")).isin(known)).withColumn("value", F.trim("value"))


def normalised(kind: Column, raw: Column, dimension: Column) -> Column:
    """struct(num, flag, items, txt, status, reason) of a raw value by its field's kind.

    kind: number (with a dimension: in its base unit), price, rpm, count, flag, list, text. A declared absence has
    status 'declared_absent' and no value. What cannot be read has status 'unread' and a reason, never an error."""
    return once(F.struct(kind.alias("kind"), raw.alias("raw"), dimension.alias("dimension")), lambda p: _normalised(p["kind"], p["raw"], p["dimension"]))


def _normalised(kind: Column, raw: Column, dimension: Column) -> Column:
    unit = F.regexp_extract(raw, r"[0-9](?: )?([A-Za-z][A-Za-z.·/-]*[0-9]?)", 1)
    # One table of all dimensions' units. Money words hold no digit, so a price is the number itself.
    factors = F.create_map(*[F.lit(x) for name, units in numbers.UNITS.items() for u, f in units.items() for x in (f"{name}/{u}", f)])
    factor = factors[F.concat(dimension, F.lit("/"), F.regexp_replace(numbers.unit_slug(unit), " ", ""))]

    def read(value: Column) -> Column:
        metres = (dimension == "length") & (F.lower(unit) == "m") & (value >= 100)
        scaled = value * F.when((kind != "number") | dimension.isNull() | metres, 1.0).otherwise(factor)
        rounded = F.when((kind == "number") & dimension.isNull(), scaled).when(dimension == "volume", F.bround(scaled, 3)).otherwise(F.bround(scaled, 0))
        num = F.when(kind.isin("number", "price", "rpm"), rounded).when(kind == "count", numbers.cylinders(raw))
        return F.struct(value.alias("value"), num.alias("num"), F.when(kind == "flag", numbers.parse_flag(raw)).alias("flag"), F.when(kind == "list", split_list(raw)).alias("items"), F.when(kind == "text", F.trim(raw)).alias("txt"), is_absent(raw).alias("absent"))

    def judge(p: Column) -> Column:
        found = p["num"].isNotNull() | p["flag"].isNotNull() | (F.size(p["items"]) > 0) | (F.length(p["txt"]) > 0)
        reason = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "blank").when((kind == "number") & p["value"].isNotNull(), "unknown_unit").when(kind.isin("number", "price", "rpm", "count"), "no_number").when(kind.isin("flag", "list", "text"), "no_value").otherwise("unknown_kind")
        status = F.when(p["absent"], "declared_absent").when(F.coalesce(found, F.lit(False)), "read").otherwise("unread")
        cells = [F.when(~p["absent"], p[c]).alias(c) for c in ("num", "flag", "items", "txt")]
        return F.struct(*cells, status.alias("status"), F.when(status == "unread", reason).alias("reason"))

    return once(once(numbers.parse_number(raw), read), judge)


def pair_facts(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with field, kind and the normalised value; labels (see label_map) is a literal table."""
    known = labels.select(F.col("label").alias("_known"), "field", "kind", "dimension")
    j = pairs.join(known, label(F.col("label")) == F.col("_known"))
    return j.withColumn("n", normalised(F.col("kind"), F.col("value"), F.col("dimension"))).select(*pairs.columns, "field", "kind", "n.*")


def first_alternative(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule (name, pattern), most specific first, that a text meets; null where none does."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def values_near(text: Column, anchor: str, value: str, reach: int) -> Column:
    """array<string>: behind each anchor the nearest value within reach characters of its line. The patterns have
    groups that capture nothing."""
    return F.regexp_extract_all(text, F.lit(rf"(?:{anchor})[^\n]{{0,{reach}}}?({value})"), F.lit(1))
