"""The fact model over the star schema: parts are entities, their line items the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import cents
from ..operators import facts
from .registry import table

HOME = "Brand#1"
FIELDS = [
    ("price", "number", "p_retailprice"), ("unit_price", "number", "unit_price"), ("size", "number", "p_size"), ("discount", "number", "discount"),
    ("returned", "bool", "returned"), ("open", "bool", "open"), ("flags", "list", "flags"), ("kind", "text", "p_type"),
]
#: field, group, kind, absolute and relative tolerance, better direction, having is better, list can be ordered.
SPEC_ROWS = [
    ("price", "value", "number", None, 0.005, "low", False, False), ("unit_price", "value", "number", None, 0.02, "low", False, False),
    ("size", "body", "number", 1.0, None, "high", False, False), ("discount", "terms", "number", 0.001, None, "high", False, False),
    ("returned", "record", "bool", None, None, None, False, False), ("open", "record", "bool", None, None, None, True, False),
    ("flags", "record", "list", None, None, None, False, True), ("kind", "body", "text", None, None, None, False, False),
]


def spec(spark: SparkSession) -> DataFrame:
    return facts.spec_table(spark, SPEC_ROWS)


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part, with what its line items say; nulls where it has none."""
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        cents(dec("l_extendedprice") / dec("l_quantity")).alias("unit_price"), (F.max("l_discount") + F.lit(0.0)).alias("discount"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
        F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.count("*").alias("n_items"),
    )
    part = table(spark, sf_dir, "part")
    return part.join(li, part.p_partkey == li.l_partkey, "left").drop("l_partkey")


def long_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.long_facts(sheet(spark, sf_dir), "p_partkey", FIELDS)


def pairs(spark: SparkSession, sf_dir: str, home: str = HOME) -> DataFrame:
    """(home, competitor, brand): each part of another brand with the cheapest home part of its type and size band;
    no row where there is none."""
    p = table(spark, sf_dir, "part").withColumn("band", F.floor(F.col("p_size") / 10))
    own = p.where(F.col("p_brand") == home).groupBy("p_type", "band").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("home"))
    return p.where(F.col("p_brand") != home).join(own, ["p_type", "band"]).select("home", F.col("p_partkey").alias("competitor"), F.col("p_brand").alias("brand"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, field, num, source, tier, quote, ts) of every line item: three fields, the supplier as source."""
    li = table(spark, sf_dir, "lineitem")
    one = lambda name, col: F.struct(F.lit(name).alias("field"), col.alias("num"))
    claims = F.array(one("unit_price", cents(F.col("l_extendedprice") / F.col("l_quantity"))), one("discount", F.col("l_discount") + F.lit(0.0)), one("tax", F.col("l_tax") + F.lit(0.0)))
    quote = F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return li.select(
        F.col("l_partkey").alias("entity"), F.explode(claims).alias("c"), F.col("l_suppkey").alias("source"), (1 + F.pmod("l_suppkey", F.lit(5))).cast("int").alias("tier"), quote.alias("quote"),
        F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"),
    ).select("entity", "c.field", "c.num", "source", "tier", "quote", "ts", "order", "line")


OBS_SPEC = [("unit_price", "value", "number", None, 0.25, "low", False, False), ("discount", "terms", "number", 0.05, None, "high", False, False), ("tax", "terms", "number", 0.04, None, "low", False, False)]

SHEET = """
li AS (
  SELECT l_partkey, floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS unit_price,
         max(l_discount) + 0.0 AS discount, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS open, list_sort(list(DISTINCT l_returnflag)) AS flags, count(*) AS n_items
  FROM lineitem GROUP BY l_partkey
), sheet AS (SELECT part.*, li.* EXCLUDE (l_partkey) FROM part LEFT JOIN li ON p_partkey = l_partkey)"""
_CELL = {"number": ("CAST({} AS DOUBLE)", 0), "bool": ("{}", 1), "list": ("{}", 2), "text": ("{}", 3)}
_NULLS = ["CAST(NULL AS DOUBLE)", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS VARCHAR[])", "CAST(NULL AS VARCHAR)"]


def _fact(field: str, kind: str, col: str) -> str:
    cells = list(_NULLS)
    form, at = _CELL[kind]
    cells[at] = form.format(col)
    return f"SELECT p_partkey AS entity, '{field}' AS field, {cells[0]} AS num, {cells[1]} AS flag, {cells[2]} AS items, {cells[3]} AS txt FROM sheet"


_sql = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else f"'{v}'"
SPEC = "spec(field, grp, kind, tol_abs, tol_rel, direction, has_is_better, orderable) AS (VALUES " + ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in SPEC_ROWS) + ")"
_UNION = " UNION ALL ".join(_fact(*f) for f in FIELDS)
FACTS = f"""{SHEET}, fact0 AS ({_UNION}),
fact AS (SELECT *, CASE WHEN num IS NULL AND flag IS NULL AND len(coalesce(items, [])) = 0 AND trim(coalesce(txt, '')) = '' THEN 'not_found' ELSE 'verified' END AS status FROM fact0)"""
PAIRS = f"""
own AS (SELECT p_type, p_size // 10 AS band, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS home FROM part WHERE p_brand = '{HOME}' GROUP BY ALL),
pair AS (SELECT home, p_partkey AS competitor, p_brand AS brand FROM part JOIN own ON part.p_type = own.p_type AND p_size // 10 = band WHERE p_brand <> '{HOME}')"""
ALIGNED = f"""{FACTS}, {PAIRS}, {SPEC},
aligned AS (
  SELECT pair.*, spec.*, h.num AS hn, h.flag AS hb, h.items AS hi, h.txt AS ht, h.status AS hs, c.num AS cn, c.flag AS cb, c.items AS ci, c.txt AS ct, c.status AS cs
  FROM pair CROSS JOIN spec LEFT JOIN fact h ON h.entity = home AND h.field = spec.field LEFT JOIN fact c ON c.entity = competitor AND c.field = spec.field
)"""


def parity_sql(aligned: str = "aligned", name: str = "par") -> str:
    """SQL of the parity state and reason of each aligned row."""
    return f"""{name} AS (
  SELECT *, CASE WHEN hs = 'not_found' OR cs = 'not_found' THEN 'unknown'
    WHEN kind = 'list' THEN CASE WHEN len(list_filter(hi, lambda x: NOT list_contains(ci, x))) = 0 AND len(list_filter(ci, lambda x: NOT list_contains(hi, x))) = 0 THEN 'parity'
      WHEN len(list_filter(ci, lambda x: NOT list_contains(hi, x))) = 0 THEN 'advantage' WHEN len(list_filter(hi, lambda x: NOT list_contains(ci, x))) = 0 THEN 'gap' ELSE 'unknown' END
    WHEN kind = 'bool' THEN CASE WHEN hb = cb THEN 'parity' WHEN NOT has_is_better THEN 'unknown' WHEN hb THEN 'advantage' ELSE 'gap' END
    WHEN kind = 'number' THEN CASE WHEN coalesce(abs(cn - hn) <= tol_abs, false) OR coalesce(abs(cn - hn) <= tol_rel * abs(hn), false) THEN 'parity'
      WHEN (direction = 'low' AND hn < cn) OR (direction = 'high' AND hn > cn) THEN 'advantage' ELSE 'gap' END
    WHEN lower(ht) = lower(ct) THEN 'parity' ELSE 'unknown' END AS state,
  CASE WHEN hs = 'not_found' AND cs = 'not_found' THEN 'no_data_on_both' WHEN hs = 'not_found' THEN 'no_data_home' WHEN cs = 'not_found' THEN 'no_data_competitor'
    WHEN kind = 'list' AND len(list_filter(hi, lambda x: NOT list_contains(ci, x))) > 0 AND len(list_filter(ci, lambda x: NOT list_contains(hi, x))) > 0 THEN 'crossing_sets'
    WHEN (kind = 'bool' AND hb <> cb AND NOT has_is_better) OR (kind = 'text' AND lower(ht) <> lower(ct)) THEN 'no_order_of_merit' ELSE '' END AS reason,
  CASE WHEN kind = 'number' AND hs <> 'not_found' AND cs <> 'not_found' THEN round(hn - cn, 4) END AS difference
  FROM {aligned})"""


OBS = """
obs AS (
  SELECT l_partkey AS entity, unnest([struct_pack(field := 'unit_price', num := floor(l_extendedprice / l_quantity * 100 + 0.5::DOUBLE) / 100.0::DOUBLE), struct_pack(field := 'discount', num := l_discount + 0.0), struct_pack(field := 'tax', num := l_tax + 0.0)], recursive := true),
         l_suppkey AS source, CAST(1 + l_suppkey % 5 AS INTEGER) AS tier, l_returnflag || '/' || l_linestatus || '/' || l_linenumber AS quote, l_shipdate AS ts, l_orderkey AS ord, l_linenumber AS line
  FROM lineitem)"""
