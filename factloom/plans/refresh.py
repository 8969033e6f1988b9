"""Queries of what is read, written and searched again: sections of claims, changed blocks, keyed writes, rounds, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rounds, scope
from ..operators.staging import new_path
from ..sources import sinks
from ..streaming import monitor, reading
from .registry import query, table


@query("""WITH i AS (SELECT l_orderkey, l_linenumber AS n, CASE l_orderkey % 2 WHEN 0 THEN 'xl' ELSE 'xlt' END AS want, l_orderkey % 3 = 0 AS asks, l_linenumber = 7 AND l_orderkey % 5 = 0 AS named FROM lineitem)
SELECT l_orderkey, n AS l_linenumber, CASE WHEN named AND want <> 'xl' THEN 'other_version' WHEN n = 1 THEN NULL WHEN n IN (2, 4) AND want <> 'xl' THEN 'other_version_section' WHEN n = 5 AND want <> 'xlt' THEN 'other_version_section'
WHEN n IN (3, 6) AND NOT asks THEN 'option_section' WHEN n = 7 THEN 'other_version_section' END AS refused FROM i""")
def claim_sections(spark, sf_dir):
    """Each item of an order as a claim against the order's sheet, which has sections of versions and of options."""
    heads = {2: "## XL 2026", 3: "### Pacote opcional", 4: "### Itens de série", 5: "## XLT 3.0", 6: "Pacotes de opcionais:", 7: "## **Raptor 2026**"}
    li, n, key = table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), F.col("l_orderkey")
    quote = F.concat(F.lit("Item o"), key.cast("string"), F.lit("-"), n.cast("string"), F.when((n == 7) & (key % 5 == 0), F.lit(" (XL)")).otherwise(F.lit(".")))
    # Every heading stands in every sheet, as items may be missing.
    line = F.transform(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(heads.get(k)).alias("head")) for k in range(1, 8)]), lambda h: F.concat_ws("\n", h["head"], F.transform(F.filter("items", lambda x: x["n"] == h["n"]), lambda x: x["q"])))
    docs = li.groupBy("l_orderkey").agg(F.collect_set(F.struct(n.alias("n"), quote.alias("q"))).alias("items")).select("l_orderkey", F.array_join(line, "\n").alias("text"))
    claims = li.select("l_orderkey", "l_linenumber", F.when(key % 2 == 0, "XL").otherwise("XLT").alias("version"), quote.alias("quote"), (key % 3 == 0).alias("asks_option"))
    return scope.claim_scope(claims, docs, id_col="l_orderkey").select("l_orderkey", "l_linenumber", "refused")


_L = "string_split(text, chr(10))"


@query(f"""WITH o AS (SELECT doc_id, {_L} AS a FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN list_concat(['(revised)'], a[2:]) ELSE list_concat(a, ['(added)']) END AS a FROM o),
b AS (SELECT 0 AS v, doc_id, k AS block, sha256(array_to_string(a[k * 3 + 1 : k * 3 + 3], chr(10))) AS digest FROM o, range(100000) AS r(k) WHERE k * 3 < len(a) UNION ALL SELECT 1, doc_id, k, sha256(array_to_string(a[k * 3 + 1 : k * 3 + 3], chr(10))) FROM n, range(100000) AS r(k) WHERE k * 3 < len(a))
SELECT x.doc_id, CAST(x.block AS INTEGER) AS block, x.digest, CASE WHEN y.digest IS NULL THEN 'new' ELSE 'changed' END AS change FROM b x LEFT JOIN b y ON y.v = 0 AND x.doc_id = y.doc_id AND x.block = y.block WHERE x.v = 1 AND x.digest IS DISTINCT FROM y.digest""")
def changed_blocks(spark, sf_dir):
    """Documents delivered again, some with another first line and some with a line more: the blocks to read anew."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    every, k = F.split("text", "\n"), F.pmod("doc_id", F.lit(3))
    first = F.concat(F.array(F.lit("(revised)")), F.slice(every, F.lit(2), F.size(every)))
    later = d.withColumn("text", F.array_join(F.when(k == 0, every).when(k == 1, first).otherwise(F.concat(every, F.array(F.lit("(added)")))), "\n"))
    return reading.changed_blocks(reading.blocks(d, 3), reading.blocks(later, 3))


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS k FROM lineitem WHERE l_linestatus = 'F' OR l_quantity IS NULL)
SELECT l_partkey AS part, l_suppkey AS supplier, l_quantity AS value, l_orderkey AS o, l_linenumber AS line FROM g WHERE k = 1""")
def keyed_upsert(spark, sf_dir):
    """The last proven quantity of each part and supplier in a table written twice over, in parts that overlap."""
    v = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("value"), F.concat_ws(" ", F.lit("qty"), F.col("l_quantity").cast("string")).alias("quote"), (F.col("l_linestatus") == "F").alias("located"),
        F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"))
    path = new_path(spark)
    for part in ("line <= 3", "line >= 2", "line >= 2"):
        sinks.upsert(v.where(part), path, ["part", "supplier"], ["at", "o", "line"], 8)
    return spark.read.parquet(path).select("part", "supplier", "value", "o", "line")


@query("""WITH w AS (SELECT p_partkey AS entity, unnest(['unit_price', 'tax']) AS field FROM part), t AS (SELECT l_partkey AS entity, min(1 + l_suppkey % 5) AS r FROM lineitem WHERE l_quantity <= 5 GROUP BY 1),
f AS (SELECT entity, field, CAST(r AS INTEGER) AS round FROM w JOIN t USING (entity)),
c AS (SELECT (SELECT count(*) FROM w) AS n, count(*) FILTER (round = 1) AS f1, count(*) FILTER (round = 2) AS f2, count(*) FILTER (round = 3) AS f3 FROM f)
SELECT entity, field, round, CASE WHEN n = f1 THEN 'no_gap' WHEN f1 = 0 THEN 'no_progress' WHEN n = f1 + f2 THEN 'no_gap' WHEN f2 = 0 THEN 'no_progress' ELSE 'rounds' END AS stop FROM f, c WHERE round <= 3 AND (round = 1 OR f1 > 0) AND (round < 3 OR f2 > 0)""")
def gap_rounds(spark, sf_dir):
    """Missing values sought tier by tier, at most three rounds: where each was found, and why the search ended."""
    told = table(spark, sf_dir, "lineitem").where("l_quantity <= 5").select(F.col("l_partkey").alias("entity"), (1 + F.pmod("l_suppkey", F.lit(5))).alias("tier"), "l_tax", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    one = lambda name, c: F.struct(F.lit(name).alias("field"), F.col(c).alias("num"))
    obs = told.select("entity", "tier", F.explode(F.array(one("unit_price", "unit_price"), one("tax", "l_tax"))).alias("f")).select("entity", "tier", "f.*")
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.explode(F.array(F.lit("unit_price"), F.lit("tax"))).alias("field"))
    out = rounds.fill_gaps(wanted, ["entity", "field"], lambda gaps, k: obs.where(F.col("tier") == k).select("entity", "field", "num"), rounds.Budget(rounds=3))
    return out.known.select("entity", "field", "round", F.lit(str(out.stop)).alias("stop"))


_EDGES = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0]


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n, [{', '.join(f'count(*) FILTER (value <= {e})' for e in _EDGES)}] AS le FROM events GROUP BY 1),
r AS (SELECT *, 0.95::DOUBLE * n AS rank, list_position(list_transform(le, lambda x: x >= 0.95::DOUBLE * n), true) AS i, {_EDGES}::DOUBLE[] AS e FROM h),
s AS (SELECT *, coalesce(e[i - 1], 0::DOUBLE) AS lo, CASE WHEN i = 1 THEN 0 ELSE le[i - 1] END AS past FROM r)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n, round(CASE WHEN i IS NULL THEN {_EDGES[-1]}::DOUBLE ELSE lo + (e[i] - lo) * (rank - past) / (le[i] - past) END, 4) AS p FROM s""")
def p95_by_buckets(spark, sf_dir):
    """The hours' 95th percentile from counts of buckets, as a stream can keep them."""
    return monitor.bucket_quantile(table(spark, sf_dir, "events"), "1 hour", 0.95, _EDGES).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
