"""Table grids as cells: labels carried down, merged cells spread, one column cut out, areas joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import label

CELL = "table_id bigint, row int, col int, span int, value string"


def cells(tables: DataFrame, id_col: str, grid_col: str) -> DataFrame:
    """(id_col, row, col, value) of grids held as array<array<string>>."""
    rows = tables.select(id_col, F.posexplode(grid_col).alias("row", "line"))
    return rows.select(id_col, "row", F.posexplode("line").alias("col", "value"))


def labelled(grid: DataFrame, id_col: str) -> DataFrame:
    """Cells with the label of their row: that of column 0 or, where it is blank, the last one above."""
    own = F.max(F.when(F.col("col") == 0, F.nullif(F.trim("value"), F.lit("")))).over(W.partitionBy(id_col, "row"))
    above = W.partitionBy(id_col).orderBy("row").rangeBetween(W.unboundedPreceding, 0)
    return grid.withColumn("_own", own).withColumn("label", F.last("_own", ignorenulls=True).over(above)).drop("_own")


def spread(grid: DataFrame, id_col: str) -> DataFrame:
    """Blank cells take the value of the merged cell to their left, as far as its span reaches."""
    by = W.partitionBy(id_col, "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    full = F.nullif(F.trim("value"), F.lit("")).isNotNull()
    left = F.last(F.when(full, F.struct("col", "span", "value")), ignorenulls=True).over(by)
    reach = left["col"] + F.coalesce(left["span"], F.lit(1)) > F.col("col")
    return grid.withColumn("value", F.when(full, F.col("value")).when(reach, left["value"]))


def column_of(grid: DataFrame, id_col: str, heading: str) -> DataFrame:
    """(id_col, label, value) of the one column whose heading in row 0 is this; a table with none or several such
    columns gives nothing."""
    head = F.when((F.col("row") == 0) & (F.lower(F.trim("value")) == heading.lower()), F.struct("col"))
    whole = W.partitionBy(id_col)
    # All windows are by table, so cells are shuffled once; headings are not joined, as no one knows how many tables there are.
    body = labelled(spread(grid.where(F.col(id_col).isNotNull()).withColumn("_head", head).repartition(id_col), id_col), id_col)
    body = body.withColumn("_at", F.min("_head").over(whole)["col"]).withColumn("_n", F.count("_head").over(whole))
    return body.where("row > 0 and col > 0 and _n = 1 and col = _at and value is not null").select(id_col, "row", "label", "value")


#: Marks that fill a cell without a value.
NO_CELL = r"^[\s\-–—•]*$"


def cell_facts(grid: DataFrame, id_col: str, heading: str, rules: list[tuple[str, str, int, str, str, str | None, str]]) -> DataFrame:
    """(id_col, row, label, field, raw, quote, num, flag, items, txt, status, reason): what the cells of one version's
    column say, as facts.

    rules: label as label() folds it, pattern, group of the value, field, kind, dimension, unit put behind it; a cell
    whose value no pattern of its label fits gives nothing, one that several rules fit gives a fact of each field, the
    first rule of a field winning. A label may carry a footnote's digit behind its last word. The quote is the cell as
    it stands, since label and value are not side by side in the source. Cells of marks alone have no value; merged
    cells reach as far as their span, and labels as far as the next."""
    from .labels import normalised
    from .tables import literal

    spark = grid.sparkSession
    table = literal(spark, [(i, *r) for i, r in enumerate(rules)], "nth int, known string, pattern string, grp int, field string, kind string, dimension string, unit string")
    body = column_of(grid, id_col, heading).where(~F.col("value").rlike(NO_CELL)).withColumn("_l", label(F.col("label")))
    bare = F.regexp_replace("_l", r"([a-z)])[0-9]$", "$1")
    j = body.join(table, (F.col("known") == F.col("_l")) | (F.col("known") == bare))
    raw = F.call_function("regexp_extract", F.trim("value"), F.col("pattern"), F.col("grp"))
    j = j.withColumn("raw", raw).where("raw <> ''")
    first = j.groupBy(id_col, "row", "field").agg(F.min_by(F.struct("label", "raw", "value", "kind", "dimension", "unit"), "nth").alias("f")).select(id_col, "row", "field", "f.*")
    said = F.when(F.col("unit") == "", F.col("raw")).otherwise(F.concat_ws(" ", "raw", "unit"))
    return first.withColumn("n", normalised(F.col("kind"), said, F.col("dimension"))).select(id_col, "row", "label", "field", "raw", F.col("value").alias("quote"), "n.*")


def area_of_union(boxes: DataFrame, key: str) -> DataFrame:
    """(key, area): area that rectangles (x0, y0, x1, y1) cover together. Boxes are cut where any box of their page
    begins or ends; in each strip the heights that boxes add to those before them are summed, so a page spreads over
    its strips. Boxes without an area, and null keys or sides, count for nothing."""
    b = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), "x0", "x1", "y0", "y1").distinct()
    cuts = b.select("_k", F.explode(F.array("x0", "x1")).alias("at")).distinct()
    strips = cuts.withColumn("to", F.lead("at").over(W.partitionBy("_k").orderBy("at"))).where("to is not null")
    cut = strips.join(b, "_k").where("x0 <= at and x1 >= to")
    below = F.max("y1").over(W.partitionBy("_k", "at").orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1))
    adds = F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce(below, F.col("y0"))))
    return cut.withColumn("area", (F.col("to") - F.col("at")) * adds).groupBy(F.col("_k").alias(key)).agg(F.sum("area").alias("area"))


def canonical(rows: DataFrame, vocabulary: DataFrame, field: str, token: Column) -> DataFrame:
    """rows with canonical: the vocabulary's word for (field, token), else the token without hyphens, else a slug."""
    from ..functions.text import fold, slug

    # Spark broadcasts the vocabulary where its size allows.
    v = vocabulary.select(F.col("field").alias("_f"), F.col("token").alias("_t"), F.col("canonical").alias("_c"))
    t = rows.withColumn("_k", fold(token)).withColumn("_p", F.translate(fold(token), "-", ""))
    one = t.join(v, (F.col(field) == F.col("_f")) & (F.col("_k") == F.col("_t")), "left").withColumn("_c1", F.col("_c")).drop("_f", "_t", "_c")
    two = one.join(v, (F.col(field) == F.col("_f")) & (F.col("_p") == F.col("_t")), "left")
    return two.withColumn("canonical", F.coalesce("_c1", "_c", slug(token))).drop("_k", "_p", "_c1", "_f", "_t", "_c")
