"""Reading that resumes: of documents delivered again, only blocks that are new or changed are read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

NEW, CHANGED, REMOVED = "new", "changed", "removed"
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def blocks(docs: DataFrame, lines: int = 20, text_col: str = "text", id_col: str = "doc_id", passing: list[str] = []) -> DataFrame:  # noqa: B006
    """(id_col, *passing, block, body, digest): each text in blocks of whole lines, from 0; null texts have none."""
    every = F.split(F.col(text_col), "\n")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / lines).cast("int")), lambda k: F.array_join(F.slice(every, k * lines + 1, F.lit(lines)), "\n"))
    out = docs.where(F.col(text_col).isNotNull()).select(id_col, *passing, F.posexplode(parts).alias("block", "body"))
    return out.withColumn("digest", F.sha2("body", 256))


def changed_blocks(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Batch: (id_col, block, digest, change) of the blocks that differ between two readings (id_col, block, digest).
    Documents that after lacks were not delivered again and have no changes."""
    b = before.join(after.select(id_col).distinct(), id_col, "left_semi").select(id_col, "block", F.col("digest").alias("_old"))
    j = b.join(after.select(id_col, "block", "digest"), [id_col, "block"], "full")
    change = F.when(F.col("_old").isNull(), NEW).when(F.col("digest").isNull(), REMOVED).when(F.col("_old") != F.col("digest"), CHANGED)
    return j.withColumn("change", change).where("change is not null").select(id_col, "block", "digest", "change")


class _Blocks(StatefulProcessor):
    """Keeps the digest of each block of a document; a delivery emits where it differs."""

    def init(self, handle) -> None:
        self.known = handle.getMapState("blocks", "block int", "digest string")
        self.last = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, now = (self.last.get()[0] if self.last.exists() else None), None
        for part in rows:
            for v, block, digest in zip(part["version"], part["block"], part["digest"], strict=True):
                if version is None or v > version:
                    version, now = int(v), {}
                if now is not None and v == version:
                    now[int(block)] = digest
        if now is None:  # a version read before, or an older one
            return
        before = {k[0]: v[0] for k, v in self.known.iterator()} if self.known.exists() else {}
        out = [(key[0], b, d, NEW if b not in before else CHANGED) for b, d in sorted(now.items()) if before.get(b) != d]
        out += [(key[0], b, None, REMOVED) for b in sorted(before.keys() - now.keys())]
        for _, block, digest, change in out:
            if change == REMOVED:
                self.known.removeKey((block,))
            else:
                self.known.updateValue((block,), (digest,))
        self.last.update((version,))
        if out:
            yield pd.DataFrame(out, columns=["key", "block", "digest", "change"])

    def close(self) -> None:
        pass


def changes_stream(delivered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Stream: (id_col, block, digest, change) of blocks (id_col, version bigint, block, digest) as they are delivered.

    The state has one digest for each block of each document, without expiry. A delivery is all blocks of a document
    under one version; of several in a batch the greatest version is read, and one not above the last is not read
    again: a delivery repeated emits nothing."""
    kind = delivered.schema[id_col].dataType.simpleString()
    rows = delivered.select(F.col(id_col).alias("key"), F.col("version").cast("bigint"), F.col("block").cast("int"), "digest")
    out = rows.groupBy("key").transformWithStateInPandas(_Blocks(), f"key {kind}, block int, digest string, change string", "Update", "none")
    return out.withColumnRenamed("key", id_col)


@contextmanager
def keyed_state(spark: SparkSession):
    """State in RocksDB, as keyed state needs it, while a stream is started."""
    old = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_changes(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, lines: int = 20, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Read what the Parquet files of folder (id_col, version, text_col) bring since the last call with this checkpoint
    and append the changed blocks to out. Progress and state lie in checkpoint, in the shared folder."""
    stream = blocks(spark.readStream.schema(schema).parquet(folder), lines, text_col, id_col, ["version"])
    with keyed_state(spark):
        changes_stream(stream, id_col).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
