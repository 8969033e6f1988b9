"""Shared pieces: tokens and hashes as Columns, shared-folder staging, numpy n-gram hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab, newline, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column, lower: bool = False) -> Column:
    """array<string>: the words of a text; empty for null."""
    text = F.translate(text, UPPER, UPPER.lower()) if lower else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def word_hashes(text: Column, lower: bool = False) -> Column:
    """array<bigint>: one 64-bit hash for each word."""
    return F.transform(words(text, lower), lambda w: F.xxhash64(w))


def row_key(*cols: Column) -> Column:
    """64-bit surrogate of a row; rows equal in cols share it, so repeated rows get equal results."""
    return F.xxhash64(*cols)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/factloom"


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, units: int = 0, unit_size: int = 1) -> int:
    """Shuffle partitions: the session's number, or more where units of work ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // unit_size))


_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S32)
    h *= _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S32
    return h


def ngrams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n items, by doubling: runs of 1, 2, 4, ... joined as n's binary digits ask."""
    count = len(w) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    spans = {1: mix(w + _M2)}
    s = 1
    while 2 * s <= n:
        h = spans[s]
        spans[2 * s] = mix(h[:-s] * _M1 + h[s:])
        s *= 2
    acc, at = None, 0
    while s:
        if n & s:
            part = spans[s][at : at + count]
            acc = part if acc is None else mix(acc * _M1 + part)
            at += s
        s //= 2
    return acc


def list_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list<int64> column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


#: A record is common when more than 1 in COMMON_RECORDS of all rows meet it.
COMMON_RECORDS = 10_000


def meet(rows: DataFrame, records: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to records, unique by `on`, by inner or left join; records' column `count` is the number of rows
    that meet a record, total that of all rows. `on` has no nulls.

    Rows of a common record meet it where they lie: there are fewer than COMMON_RECORDS such records, so they are
    broadcast. Only the others are dealt by `on`."""
    common = records.where(F.col(count) * COMMON_RECORDS > total).drop(count)
    near = rows.join(F.broadcast(common), on)
    far = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(records.drop(count), on, how)
    return near.unionByName(far)
