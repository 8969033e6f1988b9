"""Sinks: gated values, capture folders, long tables, CSV with caveats, table definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import exists, staged
from ..operators.tables import latest


def gated(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(may be written, may not): a value without a located quote is not written."""
    proven = F.coalesce(F.trim(F.col("quote")), F.lit("")) != ""
    held = (F.col("value").isNotNull()) & ~(proven & F.coalesce(F.col("located"), F.lit(False)))
    return values.where(~held), values.where(held).withColumn("reason", F.when(~proven, "no quote").otherwise("quote not located"))


def upsert(values: DataFrame, path: str, keys: list[str], newest: list[str], buckets: int = 64) -> DataFrame:
    """Write values behind the quote gate into the Parquet table at path, one row for each key; returns those held.

    values: keys, value, quote, located and more, the same columns each time. Of rows of a key, stored or new, the
    greatest in the columns `newest` stays, then the greatest in all others, so a write repeated, or told twice, leaves
    the table as it is. The table lies in `buckets` folders by a hash of the key; only those that new rows fall into
    are read, merged into the shared folder and then put in place of the old by a dynamic overwrite. A write that fails
    before that leaves the table untouched. buckets is fixed by the first write; one writer at a time. Keys are not
    null: such rows are held too."""
    spark = values.sparkSession
    good, held = gated(values)
    nameless = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    held = held.unionByName(good.where(nameless).withColumn("reason", F.lit("no key")))
    new = good.where(~nameless).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return held
    if exists(spark, path):
        new = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*new.columns).unionByName(new)
    rest = [c for c in values.columns if c not in (*keys, *newest)]
    merged = staged(latest(new, keys, [F.desc_nulls_last(c) for c in (*newest, *rest)]))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return held


def write_captures(texts: DataFrame, path: str) -> None:
    """Text with its sha256 and size, in a folder for each version."""
    texts.withColumn("sha256", F.sha2("text", 256)).withColumn("bytes", F.octet_length("text")).write.mode("append").partitionBy("version_id").parquet(path)


def write_long(long: DataFrame, path: str, by: str = "field") -> None:
    long.write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, caveats: list[str] = ()) -> None:
    """CSV parts with ; and a header; caveats go to a part folder of their own, so rows need not meet in one task."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(f"{path}/rows")
    if caveats:
        df.sparkSession.createDataFrame([(c,) for c in caveats], "caveat string").coalesce(1).write.mode("overwrite").option("sep", ";").csv(f"{path}/caveats")


def table_definition(df: DataFrame, name: str, partition: str, cluster: list[str]) -> str:
    """CREATE TABLE for a Parquet table partitioned by one column and bucketed by others."""
    cols = ",\n  ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return f"CREATE TABLE {name} (\n  {cols}\n) USING parquet PARTITIONED BY ({partition}) CLUSTERED BY ({', '.join(cluster)}) INTO 64 BUCKETS"


def exposition(counters: DataFrame, name: str) -> DataFrame:
    """Lines of a metrics page for counters (labels map<string,string>, value)."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return counters.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")).alias("line"))
