"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import meet, row_key, staged

#: Fewest key ranges of a source, and about how many rows of a source there are in each; a range is summed and
#: scanned in one task.
RANGES, ROWS = 1024, 262_144
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with target: sources by code point, null last, weigh `weights`, repeating, and
    share the total size; a target stops at epochs times its source's size and the excess is shared again.

    The fair level L with sum(min(epochs * size, L * weight)) = total is found by one scan of the sources in
    order of cap over weight: the first source whose cap is not below the level of those left ends the capped.
    One row for each source enters this single-task step.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("place", F.row_number().over(by))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def _described(rows: DataFrame, id_: Column, text: Column, source: Column) -> DataFrame:
    """(_at, _id, _row, source, size, copy) of rows, which have a number _at of their own; staged.

    copy numbers the rows equal in id, text and source, from 0, whichever of them is which. Only keys that repeat are
    numbered: rows of a key are counted by blocks of _at (a task's rows), so a key that very many rows share is
    numbered in as many tasks as hold it."""
    d = staged(rows.select("_at", id_.alias("_id"), row_key(id_, text).alias("_row"), source.alias("source"), n_words(text).alias("size")))
    d = d.withColumn("_key", row_key(F.col("_row"), F.col("source"), F.col("size")))
    repeated = staged(d.groupBy("_key").agg(F.count("*").alias("c")).where("c > 1"))
    if repeated.isEmpty():
        return d.drop("_key").withColumn("copy", F.lit(0).cast("bigint"))
    d = meet(d, repeated.withColumn("again", F.lit(True)), ["_key"], "c", d.count(), "left")
    d = staged(d.withColumn("block", F.shiftright("_at", 33)))
    once, more = d.where("again is null"), d.where("again")
    before = W.partitionBy("_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = more.groupBy("_key", "block").agg(F.count("*").alias("c")).withColumn("past", F.coalesce(F.sum("c").over(before), F.lit(0)))
    more = more.withColumn("i", F.row_number().over(W.partitionBy("_key", "block").orderBy("_at"))).join(blocks.drop("c"), ["_key", "block"])
    names = ["_at", "_id", "_row", "source", "size"]
    return staged(once.select(*names, F.lit(0).cast("bigint").alias("copy")).unionByName(more.select(*names, (F.col("past") + F.col("i") - 1).alias("copy"))))


def _taken(d: DataFrame, seed: int, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """What _described returns, with source_size, target and taken."""
    key = F.when(F.col("copy") == 0, F.xxhash64("_row", F.lit(seed))).otherwise(F.xxhash64("_row", F.lit(seed), "copy"))
    d = d.withColumn("k", key)
    bits = (max(RANGES, -(-d.count() // ROWS)) - 1).bit_length()
    d = d.withColumn("range", F.shiftrightunsigned("k", 64 - bits).cast("int"))
    sums = staged(d.groupBy("source", "range").agg(F.sum("size").alias("s")))
    sources = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, epochs)
    by = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("s").over(by), F.lit(0))).join(sources.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    offsets = staged(offsets.select(F.coalesce("source", F.lit("")).alias("_s"), F.isnull("source").alias("_n"), F.col("range").alias("_r"), "before", "source_size", "target"))
    keyed = d.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.isnull("source")).withColumn("_r", F.col("range"))
    # Unsigned order of k within a range is its order as a signed number: the high bits agree.
    inner = W.partitionBy("_s", "_n", "_r").orderBy("k", "_id", "size", "copy").rowsBetween(W.unboundedPreceding, -1)
    j = keyed.join(offsets, ["_s", "_n", "_r"]).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    return j.withColumn("taken", (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))).cast("long"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 7, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(id_col, row_key, size, source_size, target, taken) for every row of docs.

    size: words of the text (null: 0). taken: words the mix takes from the row, repeats counted: every whole epoch
    that the target holds, then the rows in hash-random order until the words left are used up, the last row in
    part. Sums of taken are the whole words of the targets; reruns agree. Rows equal in id, text and source are
    numbered and have a place each; which of them is which makes no difference to the rows returned. Extra columns are
    not read.

    The rows are cut into ranges of the random key within each source; prefix sums run over the ranges' totals,
    then inside each range. Ranges grow in number with the rows, so a range of a source of any share stays small.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_at"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    j = _taken(_described(rows, F.col("_id"), F.col("_text"), F.col("_source")), seed, weights, epochs)
    return j.select(F.col("_id").alias(id_col), F.col("_row").alias("row_key"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 7, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; a row taken in part counts as whole, so a
    source exceeds its target by less than one row. Rows without words go: the mix takes nothing from them.

    Rows are staged with a number each, by which they meet what the mix takes of them."""
    # A row travels as one struct, so its columns may have any names.
    rows = staged(docs.select(F.monotonically_increasing_id().alias("_at"), F.struct("*").alias("row")))
    column = lambda name: F.col("row").getField(name)
    took = _taken(_described(rows, column(id_col), column(text_col), column(source_col)), seed, weights, epochs)
    took = took.where("taken > 0").select("_at", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    out = rows.join(took.hint("shuffle_hash"), "_at")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
