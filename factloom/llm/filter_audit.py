"""How quality filters act on each other: survivors of every subset of filters, and of every order of them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, meet, staged, words

#: Filters of a text and its words: true where the text fails. Repetition across rows is a filter of its own.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, w: F.size(w) < 100,
    "B": lambda text, w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
    "C": lambda text, w: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text),
    "D": lambda text, w: text.rlike("[#$%&*|]"),
}
REPEATED = "E"


def flagged(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang", filters: dict = FILTERS, repeated: str = REPEATED) -> DataFrame:
    """(part, one boolean for each filter and for repetition, good, toxic) for every row of docs.

    A null text counts as empty, a null part as the empty string. repeated: the text is that of a row of smaller id,
    in any part; a row without an id neither repeats nor is repeated. good, toxic: some row of labels has quality
    or toxic 1 for the id; ids without labels, and null ids, have neither. Rows that repeat an id are judged each.

    Texts travel as SHA-256 digests. Rows of a text that very many rows have meet its smallest id where they lie.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text")).withColumn("words", words(F.col("text")))
    d = staged(d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[f(F.col("text"), F.col("words")).alias(name) for name, f in filters.items()]))
    named, nameless = d.where("id is not null"), d.where("id is null")
    texts = named.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    total = named.agg(F.count("*").alias("n")).first()["n"]
    named = meet(named, texts, ["digest"], "copies", total, "left").withColumn(repeated, F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    named = named.join(known, "id", "left")
    names = [*filters, repeated]
    no = F.lit(False)
    out = named.select("part", *names, *[F.coalesce(c, no).alias(c) for c in ("good", "toxic")])
    return out.unionByName(nameless.select("part", *filters, no.alias(repeated), no.alias("good"), no.alias("toxic")))


def survivors(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, subset, n, good, toxic): rows of each part that pass all filters of a subset, zeros included.

    subset has a bit for each filter, the last name's the lowest. One cube over part and flags: in a grouping set the
    grouped flags are the subset, and its row of all-false flags counts the survivors. Rows are first added up by part
    and flags, so the cube sees at most 2 ** filters rows of a part.
    """
    counted = staged(rows.groupBy("part", *names).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")))
    every = 2 ** len(names) - 1
    cube = counted.cube("part", *names).agg(F.grouping_id().alias("left_out"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    passed = cube.where((F.col("left_out") <= every) & ~F.greatest(*[F.coalesce(c, F.lit(False)) for c in names])).select("part", (every - F.col("left_out")).cast("int").alias("subset"), "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    return grid.join(passed, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def interactions(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step of it: filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley, as counts of rows; a part is there if a row has it.

    kept: rows left after the step; removed: those it takes out, good_lost and toxic_lost of them; redundant: rows that
    fail its filter and went before; unique_fails: rows that fail its filter alone; shapley: rows its filter takes out,
    summed over all orders. Names are single letters. The tables of pairs and steps are constants of the filters.
    """
    spark, n = rows.sparkSession, len(names)
    bit = {name: 2 ** (n - 1 - i) for i, name in enumerate(names)}
    every = 2**n - 1
    pairs = [(before, f, before | b, factorial(k) * factorial(n - 1 - k)) for f, b in bit.items() for before in range(every + 1) if not before & b for k in [before.bit_count()]]
    steps = [("".join(order), i + 1, f, sum(bit[x] for x in order[:i])) for order in permutations(names) for i, f in enumerate(order)]
    pairs = spark.createDataFrame(pairs, "before int, filter string, after int, orders long")
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    s = staged(survivors(rows, names))
    measures = ["n", "good", "toxic"]
    one = s.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in measures])
    two = s.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in measures])
    p = one.join(F.broadcast(pairs), "before").join(two, ["part", "after"])
    p = p.select("part", "before", "filter", "orders", F.col("n_after").alias("kept"), *[(F.col(f"{c}_before") - F.col(f"{c}_after")).alias(name) for c, name in zip(measures, ("removed", "good_lost", "toxic_lost"), strict=True)])
    of_filter = W.partitionBy("part", "filter")
    p = p.select(
        "part", "before", "filter", "kept", "removed", "good_lost", "toxic_lost",
        (F.max_by("removed", -F.col("before")).over(of_filter) - F.col("removed")).alias("redundant"), F.max_by("removed", "before").over(of_filter).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).over(of_filter).alias("shapley"),
    )
    return p.join(F.broadcast(steps), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, repeated: str = REPEATED, **columns) -> DataFrame:
    """Interactions of the filters and of repetition over docs. Empty docs: no rows. Extra columns are not read."""
    return interactions(flagged(docs, labels, filters=filters, repeated=repeated, **columns), [*filters, repeated])
