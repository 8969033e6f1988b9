"""Relational helpers that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants that the optimizer sees whole. schema: 'name type, ...'."""
    def sql(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int | float):
            return repr(v) + ("D" if isinstance(v, float) else "")
        if isinstance(v, list | tuple):
            return f"array({', '.join(sql(x) for x in v)})"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(sql(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")


def if_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df with a broadcast hint where it has at most `most` rows, counted first; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_parts(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """df dealt by its keys to parts of about `most` of its `rows` rows, in the session's shuffle partitions at least:
    what one task sorts or counts stays of one size, however large the table. A session's own number of partitions is
    fixed, and small compressed ones would be put together again."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // most)), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """df with its rows dealt to all cores. A narrow table's file is so small that one task or two read it, however
    many rows it has; costly Columns behind this are not left to those."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order, which should end in a unique column."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def unique_top(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows that share the first place of each key, with n_top, how many share it, and decided (n_top = 1):
    a tie is shown, never broken."""
    by = W.partitionBy(*keys)
    first = df.withColumn("_r", F.rank().over(by.orderBy(*order))).where("_r = 1").drop("_r")
    return first.withColumn("n_top", F.count("*").over(by)).withColumn("decided", F.col("n_top") == 1)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], col: str, name: str) -> DataFrame:
    """name: the last non-blank value of col up to each row of its key."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.nullif(F.col(col), F.lit("")), ignorenulls=True).over(by))


def sections(df: DataFrame, keys: list[str], pos: str, heading: Column, reach: int) -> DataFrame:
    """Rows where heading holds, with stop: the next heading's place, or reach beyond the last one."""
    by = W.partitionBy(*keys).orderBy(pos)
    return df.where(heading).withColumn("stop", F.coalesce(F.lead(pos).over(by), F.col(pos) + reach))


def asof_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """left with `value`: that of the last row of right strictly before it in time, by the same keys; null if none.

    Both sides are laid in one sequence, so no row meets more than its predecessor.
    """
    a = left.withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_tie", F.lit(0).cast("bigint"))
    b = right.select(*keys, F.col(time), F.lit(1).alias("_side"), F.col(value).alias("_v"), F.col(tie).cast("bigint").alias("_tie"))
    # At one moment the left rows come first, so what happens then is not before them.
    by = W.partitionBy(*keys).orderBy(time, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    found = both.withColumn(value, F.last(F.when(F.col("_side") == 1, F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(by)["v"])
    return found.where("_side = 0").select(*left.columns, value)


def near_in_time(anchors: DataFrame, others: DataFrame, keys: list[str], a: str, b: str, seconds: int) -> DataFrame:
    """Pairs by the same keys whose times lie at most `seconds` apart. Time is cut into buckets of that width and
    each anchor looks into three, so the join is an equality and a busy key spreads over its buckets."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    x = anchors.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(a) + d)))
    y = others.withColumn("_b", bucket(b))
    gap = F.abs(F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp")))
    return x.join(y, [*keys, "_b"]).where(gap <= seconds * 1_000_000).drop("_b")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null for an empty whole: no share of nothing."""
    return F.round(part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def share_from(part: Column, whole: Column, least: int = 20) -> Column:
    """Per cent with one digit, null below `least` cases."""
    return F.when(whole >= least, F.round(100 * part / whole, 1))


def subset_join(queries: DataFrame, query: Column, names: DataFrame, name: Column) -> DataFrame:
    """(query, name, surplus): names that hold every word of a query, and how many more words they have. Words part at
    spaces. Queries and names meet word by word, so no name is held against every query."""
    words = lambda df, text, as_: df.select(text.alias(as_)).distinct().select(as_, F.split(as_, " ").alias("_all")).select(as_, F.size("_all").alias(f"_n_{as_}"), F.size(F.array_distinct("_all")).alias(f"_d_{as_}"), F.explode(F.array_distinct("_all")).alias("_w"))
    hits = words(queries, query, "query").join(words(names, name, "name"), "_w").groupBy("query", "name", "_n_query", "_d_query", "_n_name").agg(F.count("*").alias("_hits"))
    return hits.where("_hits = _d_query").select("query", "name", (F.col("_n_name") - F.col("_n_query")).alias("surplus"))
