"""Exact deduplication as a stream: disk-backed state of digests without expiry, bytes checked on hits."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, staged

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every partition's store lays out megabytes of empty files.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _finish(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


_PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
_GROUP = "digest string, keep_id bigint, keep_place struct<file: string, row: bigint>, group_size bigint, batch int"


def _stays(id_: str, points: str, place: str) -> Column:
    """Of copies: most code points, then smallest id, null ids last."""
    return F.max_by(F.struct(F.col(id_).alias("id"), F.col(place).alias("place")), F.struct(points, F.col(id_).isNotNull().alias("has"), (-F.col(id_)).alias("small")))


def group_stream(digests: DataFrame, path: str, checkpoint: str, check: Callable[[DataFrame, int], None]):
    """Start the stateful query: for each digest keep its count, the row that stays and where it lies.

    digests: a stream of (digest, id, points, place). The state has one entry for each digest in RocksDB and
    never expires: digest, identifier, and as content locator the file and the row in it. Each task first combines
    its own rows of a digest, so a digest of many rows reaches the state as one row a task. Each batch writes the
    entries it changed with the batch's number; check(hits, number) gets those that have more than one row.
    """
    groups = digests.groupBy("digest").agg(_stays("id", "points", "place").alias("stays"), F.count("*").alias("group_size"))

    def write(batch: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}"
        batch.select("digest", F.col("stays.id").alias("keep_id"), F.col("stays.place").alias("keep_place"), "group_size", F.lit(number).alias("batch")).write.mode("overwrite").parquet(out)
        check(batch.sparkSession.read.schema(_GROUP).parquet(out).where("group_size > 1"), number)

    return groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def byte_check(path: str, schema: T.StructType, text_col: str, digests: str, kinds: T.StructType, unequal: str):
    """A check of hits: the full texts behind a digest that was met again, fetched through the locators, must be the
    same bytes. Digests with other texts are written to unequal/batch=number."""

    def check(hits: DataFrame, number: int) -> None:
        spark = hits.sparkSession
        rows = spark.read.schema(kinds).parquet(digests).select("digest", "place")
        wanted = rows.join(hits.select("digest"), "digest", "left_semi").select("digest", "place.file", "place.row")
        held = spark.read.schema(schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.col(text_col)).alias("t"))
        # The texts' side streams; the locators, a fraction of it, are built into a table of each task.
        texts = held.join(wanted.hint("shuffle_hash"), ["file", "row"])
        found = texts.groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high"))
        found.where("low <> high").select("digest").write.mode("overwrite").parquet(f"{unequal}/batch={number}")

    return check


def deduplicate(spark: SparkSession, path: str, schema: T.StructType, text_col: str = "text", id_col: str = "doc_id", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256, keep_place) for every row of the Parquet table at path.

    Rows are copies when their texts are equal without ASCII white space (null: empty). Of copies the row with
    the most code points in the text as given, then the smallest id, stays (null ids last); rows that repeat
    that id too are all kept. An empty table gives no rows; extra columns are not read. keep_place (file, row) is
    where the row that stays lies.

    Two streams run until the files there are read: one turns rows into digests, one keeps the state. In each batch
    of the second, digests that were met before, there or earlier, are hits: their full texts are fetched through
    the locators and compared. Should bytes differ, the digest's rows are grouped by the texts themselves.
    """
    base = shared_path(spark)
    source, folder = spark.readStream.schema(schema), path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A stream watches folders: a table of one file is its name in the folder above.
        source, folder = source.option("pathGlobFilter", at.getName()), at.getParent().toString()
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    text = F.col(text_col)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    points = F.coalesce(F.length(text), F.lit(0)).alias("points")
    rows = source.parquet(folder).select(F.col(id_col).alias("id"), digest(normalised(text)).alias("digest"), points, place)
    _finish(rows.writeStream.format("parquet").option("path", f"{base}/digests").option("checkpointLocation", f"{base}/digests-log").trigger(availableNow=True).start())
    kinds = T.StructType([T.StructField("id", schema[id_col].dataType), T.StructField("digest", T.StringType()), T.StructField("points", T.IntegerType()), T.StructField("place", _PLACE)])
    digests_path, unequal_path = f"{base}/digests", f"{base}/unequal"
    stream = spark.readStream.schema(kinds)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    with _settings(spark, _STATE):
        _finish(group_stream(stream.parquet(digests_path), f"{base}/groups", f"{base}/state", byte_check(path, schema, text_col, digests_path, kinds, unequal_path)))
    written = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/groups")
    if not written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(written):
        return spark.createDataFrame([], f"{id_col} bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string, keep_place struct<file: string, row: bigint>")
    groups = spark.read.schema(_GROUP).parquet(f"{base}/groups")
    if files_per_batch:
        groups = staged(groups.groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_place", "group_size"), "batch").alias("g")).select("digest", "g.*"))
    digests = spark.read.schema(kinds).parquet(digests_path)
    out = digests.select("id", "digest").join(groups.select("digest", "keep_id", "group_size", "keep_place"), "digest")
    unequal = spark.read.schema("digest string").parquet(unequal_path).distinct()
    if unequal.isEmpty() and digest is sha256:
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "keep_place")
    # Other texts under one digest: group by the texts themselves.
    held = spark.read.schema(schema).parquet(path)
    every = held.select(F.col(id_col).alias("id"), normalised(text).alias("t"), points, place)
    exact = staged(every.groupBy("t").agg(_stays("id", "points", "place").alias("s"), F.count("*").alias("group_size")))
    return every.join(exact, "t").select(F.col("id").alias(id_col), F.col("s.id").alias("keep_id"), "group_size", F.col("id").eqNullSafe(F.col("s.id")).alias("kept"), sha256(F.col("t")).alias("text_sha256"), F.col("s.place").alias("keep_place"))
