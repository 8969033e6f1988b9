"""From many observations to one decision for each entity and field."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import confidence
from .facts import DECLARED_ABSENT, DIVERGENT, NOT_FOUND, VERIFIED
from .tables import latest

#: Tiers of official sources; only they can declare that something is absent.
OFFICIAL = 2


def decide(observations: DataFrame, spec: DataFrame) -> DataFrame:
    """(entity, field, status, value, low, high, best_tier, n_best, independent, contested, confidence).

    observations: entity, field, num (null: the source declares absence), source, tier, quote. The best tier decides
    alone: its numbers agree when their spread is within the field's tolerance. value: the best tier's smallest
    number. independent: sources or different quotes of the best tier, whichever are fewer. contested: numbers of
    lower tiers outside the tolerance of value; they change nothing. Each observation is shuffled once, to its tier;
    there sources and quotes are counted by their ranks as sorted rows go by, since counting both as distinct would
    send every row three times. Numbers of a tier are summarised before the tiers meet.
    """
    told = lambda c: F.when(F.col("num").isNotNull(), F.col(c)).alias(c)
    rows = observations.select("entity", "field", "tier", "num", told("source"), told("quote")).repartition("entity", "field", "tier")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.dense_rank().over(W.partitionBy("entity", "field", "tier").orderBy(F.asc_nulls_last(c))))
    tiers = rows.withColumn("_s", rank("source")).withColumn("_q", rank("quote")).groupBy("entity", "field", "tier").agg(
        F.min("num").alias("low"), F.max("num").alias("high"), F.count("num").alias("n"), F.count("*").alias("rows"), F.coalesce(F.max("_s"), F.lit(0)).alias("sources"), F.coalesce(F.max("_q"), F.lit(0)).alias("quotes"))
    best = F.min(F.when(F.col("n") > 0, F.col("tier"))).over(W.partitionBy("entity", "field"))
    tiers = tiers.withColumn("best", best)
    at_best = F.col("tier") == F.col("best")
    one = tiers.groupBy("entity", "field").agg(
        F.first("best").alias("best_tier"), F.max(F.when(at_best, F.col("low"))).alias("low"), F.max(F.when(at_best, F.col("high"))).alias("high"),
        F.max(F.when(at_best, F.col("n"))).alias("n_best"), F.max(F.when(at_best, F.least("sources", "quotes"))).alias("independent"),
        F.min(F.when(~at_best, F.col("low"))).alias("other_low"), F.max(F.when(~at_best, F.col("high"))).alias("other_high"),
        F.count_if((F.col("tier") <= OFFICIAL) & (F.col("rows") > F.col("n"))).alias("official_absences"),
    )
    one = one.join(spec.select("field", "tol_abs", "tol_rel"), "field", "left")
    agree = spread_ok(F.col("low"), F.col("high"), F.col("tol_abs"), F.col("tol_rel"))
    far = lambda c: F.coalesce(~spread_ok(F.least(F.col("low"), c), F.greatest(F.col("low"), c), F.col("tol_abs"), F.col("tol_rel")), F.lit(False))
    status = F.when(F.col("best_tier").isNull(), F.when(F.col("official_absences") > 0, DECLARED_ABSENT).otherwise(NOT_FOUND)).when(agree, VERIFIED).otherwise(DIVERGENT)
    sure = confidence(F.col("best_tier"), F.col("independent"), ~agree)
    return one.select(
        "entity", "field", status.alias("status"), F.col("low").alias("value"), "low", "high", "best_tier", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("independent", F.lit(0)).cast("bigint").alias("independent"),
        (far(F.col("other_low")) | far(F.col("other_high"))).alias("contested"), F.when(F.col("best_tier").isNotNull(), sure).alias("confidence"),
    )


def spread_ok(low: Column, high: Column, tol_abs: Column, tol_rel: Column) -> Column:
    """Whether all numbers between low and high agree pairwise: absolutely, or relatively in either direction."""
    gap = high - low
    return (gap == 0) | F.coalesce(gap <= tol_abs + 1e-9, F.lit(False)) | F.coalesce(gap <= tol_rel * F.greatest(F.abs(low), F.abs(high)), F.lit(False))


def with_requested(decisions: DataFrame, entities: DataFrame, fields: DataFrame) -> DataFrame:
    """decisions for every entity and requested field; those nobody mentions are not_found."""
    every = entities.select("entity").distinct().crossJoin(fields.select("field"))
    return every.join(decisions, ["entity", "field"], "left").withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))


def value_groups(observations: DataFrame, spec: DataFrame) -> DataFrame:
    """(entity, field, num, tier, grp): observations' distinct numbers in groups of compatible ones.

    In order of tier, then number, each joins the first group with all of whose numbers it agrees. Equal numbers of
    a tier are one. Rows stream through in order; a task holds the groups' bounds of the field it is at.
    """
    distinct = observations.where("num is not null").select("entity", "field", "tier", "num").distinct()
    rows = distinct.join(spec.select("field", "tol_abs", "tol_rel"), "field", "left")

    def changed(c: pa.Array) -> np.ndarray:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, high = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            starts = [0, *(np.flatnonzero(changed(b["entity"]) | changed(b["field"])) + 1).tolist(), b.num_rows]
            nums, mine = b["num"].to_pylist(), []
            for i, j in pairwise(starts):
                key = b["entity"][i].as_py(), b["field"][i].as_py()
                if i or key != now:  # a batch may go on with the field that the last one ended in
                    now, low, high = key, [], []
                a, r = ((c[i].as_py() if c[i].is_valid else -1.0) for c in (b["tol_abs"], b["tol_rel"]))
                a += 1e-9
                for num in nums[i:j]:
                    for k, lo in enumerate(low):
                        hi = high[k]
                        if num < lo:
                            gap = hi - num
                            if gap <= a or gap <= r * (hi if hi > -num else -num):
                                low[k] = num
                                break
                        elif num > hi:
                            gap = num - lo
                            if gap <= a or gap <= r * (num if num > -lo else -lo):
                                high[k] = num
                                break
                        elif lo == lo:  # no wider than before; a group that NaN opened takes nothing
                            break
                    else:
                        k = len(low)
                        low.append(num)
                        high.append(num)
                    mine.append(k)
            yield b.select(["entity", "field", "num", "tier"]).append_column("grp", pa.array(mine, pa.int32()))

    ordered = rows.repartition("entity", "field").sortWithinPartitions("entity", "field", "tier", "num").select("entity", "field", "num", "tier", "tol_abs", "tol_rel")
    return ordered.mapInArrow(cluster, T.StructType([*ordered.schema.fields[:4], T.StructField("grp", T.IntegerType())]))


def prefer_cells(observations: DataFrame) -> DataFrame:
    """Of one source's claims on a field, table cells silence running text."""
    by = W.partitionBy("entity", "source", "field")
    return observations.withColumn("_cell", F.max(F.col("is_cell").cast("int")).over(by)).where((F.col("_cell") == 0) | F.col("is_cell")).drop("_cell")


def prefer_specific(observations: DataFrame) -> DataFrame:
    """Claims about a whole line go where a claim about the very entity has another value."""
    by = W.partitionBy("entity", "field")
    specific = F.collect_set(F.when(F.col("specific"), F.col("num"))).over(by)
    out = observations.withColumn("_s", specific)
    return out.where(F.col("specific") | (F.size("_s") == 0) | F.array_contains("_s", F.col("num"))).drop("_s")


def fingerprint(*cols: Column) -> Column:
    """sha256 of a row's parts, null apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def append_new(log: DataFrame, incoming: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of incoming, once each, whose fingerprint the log lacks."""
    return incoming.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def changed_only(history: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """The rows that differ from the one before them: what an append-only history keeps."""
    before = F.lag(payload).over(W.partitionBy(*keys).orderBy(*order))
    return history.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(payload))).drop("_b")


def merge_latest(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both tables with one row a key, incoming rows before current ones of equal order; action tells what each
    incoming key did: inserted, replaced, or kept where the current row is newer."""
    a = current.withColumn("_new", F.lit(0))
    b = incoming.withColumn("_new", F.lit(1))
    by = W.partitionBy(*keys)
    both = a.unionByName(b).withColumn("_lo", F.min("_new").over(by)).withColumn("_hi", F.max("_new").over(by))
    top = latest(both, keys, [*order, F.col("_new").desc()])
    action = F.when(F.col("_lo") == 1, "inserted").when(F.col("_hi") == 0, "unchanged").when(F.col("_new") == 1, "replaced").otherwise("kept")
    return top.withColumn("action", action).drop("_new", "_lo", "_hi")


def orphans(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Rows that no reference names."""
    return rows.join(references.select(key).distinct(), key, "left_anti")
