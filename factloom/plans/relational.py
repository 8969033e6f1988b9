"""Queries of the relational core: joins, windows, top-k, coverage, outcomes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import quality, tables
from . import mapping as m
from .registry import query, table


@query("SELECT c_custkey, concat_ws(' ', r_name, n_name, c_name) AS label, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def catalog_star(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("c_custkey", F.concat_ws(" ", "r_name", "n_name", "c_name").alias("label"), "n_name", "r_name")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_brand, p_partkey LIMIT 100")
def catalog_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%ring%")).orderBy("p_brand", "p_partkey").limit(100).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def entities_with_sheet(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey")
    return p.join(li, p.p_partkey == li.l_partkey, "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def entities_without_sheet(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""SELECT p_partkey, coalesce(l_extendedprice, p_retailprice) AS price, CASE WHEN l_extendedprice IS NULL THEN 'catalogue' ELSE 'evidence' END AS origin, l_orderkey AS order_key
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R') ON p_partkey = l_partkey""")
def value_left_evidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R"))
    j = table(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", F.coalesce("l_extendedprice", "p_retailprice").alias("price"), F.when(F.col("l_extendedprice").isNull(), "catalogue").otherwise("evidence").alias("origin"), F.col("l_orderkey").alias("order_key"))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN true WHEN o_orderkey % 7 = 0 THEN NULL ELSE false END AS checked FROM orders)
SELECT o_orderstatus, count(*) FILTER (checked IS TRUE) AS n_simulated, count(*) FILTER (checked IS FALSE) AS n_real, count(*) FILTER (checked IS NULL) AS n_never_checked FROM o GROUP BY 1""")
def tri_state_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("checked", F.when(k % 10 == 0, F.lit(True)).when(k % 7 == 0, F.lit(None)).otherwise(F.lit(False)))
    return o.groupBy("o_orderstatus").agg(F.count_if("checked").alias("n_simulated"), F.count_if(~F.col("checked")).alias("n_real"), F.count_if(F.col("checked").isNull()).alias("n_never_checked"))


@query("""SELECT d.doc_id, CASE WHEN d.text IS NULL OR trim(d.text) = '' THEN 'missing' WHEN lower(trim(d.text)) IN ('-', 'n/d', 'n/a', 'not available') THEN 'declared_absent' ELSE 'present' END AS state, l.doc_id IS NULL AS unlabelled
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def absence_predicates(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    word = F.lower(F.trim("text"))
    state = F.when(F.col("text").isNull() | (word == ""), "missing").when(word.isin("-", "n/d", "n/a", "not available"), "declared_absent").otherwise("present")
    return d.join(lab, "doc_id", "left").select("doc_id", state.alias("state"), F.col("has").isNull().alias("unlabelled"))


@query("SELECT l_partkey, l_suppkey, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    r = tables.latest(table(spark, sf_dir, "lineitem"), ["l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])
    return r.select("l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").cast("string").alias("shipped"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_of_priority_tuple(spark, sf_dir):
    first = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return tables.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [first, F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH q AS (SELECT l_partkey, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY qty DESC) AS k FROM q),
t AS (SELECT l_partkey, count(*) AS n_top, min(l_suppkey) AS s, max(qty) AS qty FROM r WHERE k = 1 GROUP BY 1)
SELECT l_partkey, n_top, CASE WHEN n_top = 1 THEN s END AS supplier, CAST(qty AS BIGINT) AS qty FROM t""")
def unique_top_or_refuse(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    top = tables.unique_top(q, ["l_partkey"], [F.desc("qty")])
    return top.groupBy("l_partkey").agg(F.max("n_top").alias("n_top"), F.max(F.when(F.col("decided"), F.col("l_suppkey"))).alias("supplier"), F.max("qty").alias("qty"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations""")
def carry_forward_label(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") == "user", F.col("text")))
    return tables.carry_forward(c, ["conv_id"], ["turn"], "label", "asked").select("conv_id", "turn", "asked")


@query("""WITH s AS (SELECT conv_id, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 3000) AS stop FROM conversations WHERE role = 'user')
SELECT s.conv_id, start, stop, count(c.turn) AS n_turns, coalesce(sum(length(c.text)), 0)::BIGINT AS n_chars FROM s LEFT JOIN conversations c ON c.conv_id = s.conv_id AND c.turn >= start AND c.turn < stop GROUP BY ALL""")
def section_intervals(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = tables.sections(c.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "user", 3000).select("conv_id", F.col("turn").alias("start"), "stop")
    inside = c.select("conv_id", "turn", F.length("text").alias("n"))
    j = s.join(inside, "conv_id").where((F.col("turn") >= F.col("start")) & (F.col("turn") < F.col("stop")))
    return j.groupBy("conv_id", "start", "stop").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_chars"))


@query("""SELECT a.event_id AS error_id, b.event_id AS near_id, b.event_type FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error'
AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000""")
def proximity_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("a"))
    b = e.where("event_type <> 'error'").select(F.col("event_id").alias("near_id"), "user_id", "event_type", F.col("ts").alias("b"))
    return tables.near_in_time(a, b, ["user_id"], "a", "b", 300).select("error_id", "near_id", "event_type")


@query("""SELECT a.event_id, b.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts > b.ts""")
def asof_latest_before(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("event_id").alias("purchase_id"))
    return tables.asof_before(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "event_id", "purchase_id").select("event_id", "purchase_id")


_TOKENS = "string_split(p_name, ' ')"


@query(f"""WITH n AS (SELECT DISTINCT p_name, {_TOKENS} AS t FROM part), q(query) AS (VALUES ('small ring'), ('red'), ('blue bolt'), ('widget')), m AS (SELECT query, p_name FROM q, n WHERE len(list_filter(string_split(query, ' '), lambda x: NOT list_contains(t, x))) = 0)
SELECT query, count(*) AS n_names, CASE WHEN count(*) = 1 THEN min(p_name) END AS name FROM m GROUP BY query""")
def token_subset_join(spark, sf_dir):
    q = tables.literal(spark, [("small ring",), ("red",), ("blue bolt",), ("widget",)], "query string")
    hit = tables.subset_join(q, F.col("query"), table(spark, sf_dir, "part"), F.col("p_name"))
    g = hit.groupBy("query").agg(F.count("*").alias("n_names"), F.min("name").alias("first"))
    return g.select("query", "n_names", F.when(F.col("n_names") == 1, F.col("first")).alias("name"))


@query(f"""WITH n AS (SELECT DISTINCT p_name, {_TOKENS} AS t FROM part), q(query) AS (VALUES ('small ring'), ('red'), ('blue bolt'), ('widget')),
m AS (SELECT query, p_name, len(t) - len(string_split(query, ' ')) AS surplus FROM q, n WHERE len(list_filter(string_split(query, ' '), lambda x: NOT list_contains(t, x))) = 0),
r AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY surplus) AS k FROM m)
SELECT query, CAST(min(surplus) AS BIGINT) AS surplus, count(*) AS n_top, CASE WHEN count(*) = 1 THEN min(p_name) END AS name FROM r WHERE k = 1 GROUP BY query""")
def min_surplus_join(spark, sf_dir):
    q = tables.literal(spark, [("small ring",), ("red",), ("blue bolt",), ("widget",)], "query string")
    hit = tables.subset_join(q, F.col("query"), table(spark, sf_dir, "part"), F.col("p_name"))
    top = tables.unique_top(hit, ["query"], [F.col("surplus")])
    return top.groupBy("query").agg(F.min("surplus").cast("bigint").alias("surplus"), F.count("*").alias("n_top"), F.max(F.when(F.col("decided"), F.col("name"))).alias("name"))


@query("""SELECT n_name AS brand, count(DISTINCT c_custkey) AS mapped, count(DISTINCT o_custkey) AS with_sheet, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'P') AS divergent, count(DISTINCT c_custkey) - count(DISTINCT o_custkey) AS not_found,
round(count(DISTINCT o_custkey) / nullif(CAST(count(DISTINCT c_custkey) AS DOUBLE), 0), 4) AS covered FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def coverage_by_brand(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    # Orders are counted for each customer first, so a customer is one row and needs no distinct count.
    per = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    j = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    g = j.groupBy(F.col("n_name").alias("brand")).agg(F.count("c_custkey").alias("mapped"), F.count("o_custkey").alias("with_sheet"), F.coalesce(F.sum("f"), F.lit(0)).alias("verified"), F.coalesce(F.sum("p"), F.lit(0)).alias("divergent"))
    return g.withColumn("not_found", F.col("mapped") - F.col("with_sheet")).withColumn("covered", tables.ratio(F.col("with_sheet"), F.col("mapped")))


@query("""WITH v AS (SELECT l_partkey, floor(l_extendedprice / l_quantity * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS u FROM lineitem) SELECT l_partkey, count(DISTINCT u) AS n_values, CASE WHEN count(DISTINCT u) >= 2 THEN round(max(u) - min(u), 2) END AS gap FROM v GROUP BY 1""")
def divergence_gap(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_partkey", numbers.cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return quality.spread(v, ["l_partkey"], "u")


_SESSIONS = """s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'open' END AS outcome, o_orderpriority AS reason, o_orderkey % 10 = 0 AS simulated FROM orders),
c AS (SELECT DISTINCT l_orderkey, l_suppkey AS competitor FROM lineitem)"""


def _sessions(spark, sf_dir):
    st = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(st == "F", "won").when(st == "O", "lost").otherwise("open").alias("outcome"), F.col("o_orderpriority").alias("reason"), (F.col("o_orderkey") % 10 == 0).alias("simulated"))


@query(f"""WITH {_SESSIONS} SELECT competitor, simulated, count(*) AS n, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (outcome = 'open') AS open, count(*) FILTER (outcome <> 'open') AS closed,
CASE WHEN count(*) FILTER (outcome <> 'open') >= 20 THEN round(100 * count(*) FILTER (outcome = 'won') / CAST(count(*) FILTER (outcome <> 'open') AS DOUBLE), 1) END AS won_pct FROM s JOIN c ON o_orderkey = l_orderkey GROUP BY ALL""")
def win_loss_by_competitor(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("all")).select("l_orderkey", F.explode("all").alias("competitor"))
    s = _sessions(spark, sf_dir)
    return quality.outcome_counts(s.join(c, s.o_orderkey == c.l_orderkey), ["competitor", "simulated"])


@query(f"""WITH {_SESSIONS} SELECT simulated, outcome, count(*) AS n FROM s GROUP BY ALL""")
def win_loss_totals(spark, sf_dir):
    return _sessions(spark, sf_dir).groupBy("simulated", "outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {_SESSIONS}, g AS (SELECT outcome, reason, count(*) AS n FROM s WHERE NOT simulated GROUP BY ALL) SELECT outcome, reason, n, place FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY n DESC, reason) AS place FROM g) WHERE place <= 3""")
def top_reasons(spark, sf_dir):
    g = _sessions(spark, sf_dir).where(~F.col("simulated")).groupBy("outcome", "reason").agg(F.count("*").alias("n"))
    return tables.top_k(g, ["outcome"], [F.desc("n"), F.col("reason")], 3).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT p_brand, p_type, count(*) AS n, grouping(p_brand) AS over_brands, grouping(p_type) AS over_types FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())")
def grouping_sets(spark, sf_dir):
    """An extension: subtotals in one pass."""
    p = table(spark, sf_dir, "part")
    g = p.groupingSets([[p.p_brand, p.p_type], [p.p_brand], []], p.p_brand, p.p_type).agg(F.count("*").alias("n"), F.grouping("p_brand").cast("bigint").alias("over_brands"), F.grouping("p_type").cast("bigint").alias("over_types"))
    return g.select("p_brand", "p_type", "n", "over_brands", "over_types")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_operations(spark, sf_dir):
    """An extension: INTERSECT and EXCEPT."""
    o = table(spark, sf_dir, "orders")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return rich.intersect(o.where("o_orderstatus = 'F'").select("o_custkey")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_custkey, o_orderkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE), 2) AS last_three FROM orders")
def window_frames(spark, sf_dir):
    """An extension: sums over sliding frames."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(by).cast("double"), 2).alias("last_three"))


@query(f"WITH {m.SHEET} SELECT field, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM (SELECT p_brand, unnest(['unit_price', 'discount']) AS field, unnest([unit_price, discount]) AS v FROM sheet) WHERE v IS NOT NULL GROUP BY 1")
def unpivot_counts(spark, sf_dir):
    s = m.sheet(spark, sf_dir).select("p_brand", "unit_price", "discount").unpivot("p_brand", ["unit_price", "discount"], "field", "v")
    return s.where("v is not null").groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands"))
