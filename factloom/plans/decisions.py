"""Queries of reconciliation, history and the change radar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import decide, facts, radar, tables
from . import mapping as m
from .registry import query, table

_OSPEC = "ospec(field, tol_abs, tol_rel) AS (VALUES ('unit_price', NULL::DOUBLE, 0.25), ('discount', 0.05, NULL), ('tax', 0.04, NULL))"
_DECIDED = f"""{m.OBS}, {_OSPEC}, t AS (SELECT entity, field, tier, min(num) AS low, max(num) AS high, count(num) AS n, least(count(DISTINCT source), count(DISTINCT quote)) AS ind FROM obs GROUP BY ALL),
b AS (SELECT *, min(tier) OVER (PARTITION BY entity, field) AS best FROM t),
d AS (SELECT entity, field, max(best) AS best_tier, max(low) FILTER (tier = best) AS low, max(high) FILTER (tier = best) AS high, max(n) FILTER (tier = best) AS n_best, max(ind) FILTER (tier = best) AS independent, min(low) FILTER (tier <> best) AS ol, max(high) FILTER (tier <> best) AS oh FROM b GROUP BY ALL),
e AS (SELECT d.*, tol_abs, tol_rel, (high - low = 0) OR coalesce(high - low <= tol_abs + 1e-9, false) OR coalesce(high - low <= tol_rel * greatest(abs(low), abs(high)), false) AS agree FROM d JOIN ospec USING (field)),
far AS (SELECT *, ol IS NOT NULL AND NOT ((greatest(low, ol) - least(low, ol) = 0) OR coalesce(greatest(low, ol) - least(low, ol) <= tol_abs + 1e-9, false) OR coalesce(greatest(low, ol) - least(low, ol) <= tol_rel * greatest(abs(low), abs(ol)), false))
  OR oh IS NOT NULL AND NOT ((greatest(low, oh) - least(low, oh) = 0) OR coalesce(greatest(low, oh) - least(low, oh) <= tol_abs + 1e-9, false) OR coalesce(greatest(low, oh) - least(low, oh) <= tol_rel * greatest(abs(low), abs(oh)), false)) AS contested FROM e),
base AS (SELECT *, CASE WHEN best_tier <= 1 THEN 0.9 WHEN best_tier = 2 THEN 0.85 WHEN best_tier = 3 THEN 0.6 WHEN best_tier = 4 THEN 0.4 ELSE 0.2 END::DOUBLE AS base FROM far),
conf AS (SELECT *, CASE WHEN best_tier >= 3 THEN least(base + 0.05 * greatest(independent - 1, 0), 0.6) ELSE base + 0.05 * greatest(independent - 1, 0) END AS raised FROM base)"""


def _ospec(spark):
    return facts.spec_table(spark, m.OBS_SPEC)


@query(f"WITH {_DECIDED} SELECT entity, field, CASE WHEN agree THEN 'verified' ELSE 'divergent' END AS status, low AS value, low, high, CAST(best_tier AS BIGINT) AS best_tier, n_best, contested FROM conf")
def decide_fields(spark, sf_dir):
    d = decide.decide(m.observations(spark, sf_dir), _ospec(spark))
    return d.select("entity", "field", "status", "value", "low", "high", F.col("best_tier").cast("bigint").alias("best_tier"), "n_best", "contested")


@query(f"WITH {_DECIDED} SELECT entity, field, independent, round(CASE WHEN agree THEN least(raised, 1.0) ELSE base END, 4) AS confidence FROM conf")
def independent_evidence_confidence(spark, sf_dir):
    return decide.decide(m.observations(spark, sf_dir), _ospec(spark)).select("entity", "field", "independent", "confidence")


@query(f"WITH {_DECIDED}, need AS (SELECT p_partkey AS entity, unnest(['unit_price', 'discount', 'tax', 'colour']) AS field FROM part) SELECT need.field, coalesce(CASE WHEN agree THEN 'verified' WHEN NOT agree THEN 'divergent' END, 'not_found') AS status, count(*) AS n FROM need LEFT JOIN conf USING (entity, field) GROUP BY ALL")
def decide_all_requested(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"))
    need = tables.literal(spark, [("unit_price",), ("discount",), ("tax",), ("colour",)], "field string")
    d = decide.with_requested(decide.decide(m.observations(spark, sf_dir), _ospec(spark)), parts, need)
    return d.groupBy("field", "status").agg(F.count("*").alias("n"))


@query()
def value_groups(spark, sf_dir):
    """Greedy groups of compatible values; SQL has no such loop, tests compare it with one in plain Python."""
    return decide.value_groups(m.observations(spark, sf_dir), _ospec(spark))


@query(f"""WITH {m.OBS}, c AS (SELECT *, line % 2 = 1 AS is_cell FROM obs WHERE field = 'tax') SELECT entity, source, count(*) AS n, count(*) FILTER (is_cell) AS n_cells FROM (SELECT *, max(CAST(is_cell AS INTEGER)) OVER (PARTITION BY entity, source, field) AS hc FROM c) WHERE hc = 0 OR is_cell GROUP BY ALL""")
def cells_before_text(spark, sf_dir):
    o = m.observations(spark, sf_dir).where("field = 'tax'").withColumn("is_cell", F.col("line") % 2 == 1)
    # Dealt once, by what both the claims of a source and the counts keep together.
    o = tables.in_parts(o.select("entity", "source", "field", "is_cell"), table(spark, sf_dir, "lineitem").count(), "entity", "source")
    return decide.prefer_cells(o).groupBy("entity", "source").agg(F.count("*").alias("n"), F.count_if("is_cell").alias("n_cells"))


@query(f"""WITH {m.OBS}, c AS (SELECT *, tier = 1 AS specific FROM obs WHERE field = 'discount'), s AS (SELECT *, list(DISTINCT num) FILTER (specific) OVER (PARTITION BY entity) AS own FROM c)
SELECT entity, count(*) AS n, count(*) FILTER (specific) AS n_specific FROM s WHERE specific OR own IS NULL OR len(own) = 0 OR list_contains(own, num) GROUP BY 1""")
def specific_before_general(spark, sf_dir):
    o = m.observations(spark, sf_dir).where("field = 'discount'").withColumn("specific", F.col("tier") == 1)
    return decide.prefer_specific(o).groupBy("entity").agg(F.count("*").alias("n"), F.count_if("specific").alias("n_specific"))


@query("""WITH h AS (SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate, sha256(l_returnflag || chr(31) || l_linestatus) AS payload FROM lineitem),
b AS (SELECT *, lag(payload) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS before FROM h)
SELECT l_partkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, payload FROM b WHERE before IS NULL OR before <> payload""")
def history_append_only(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").withColumn("payload", decide.fingerprint(F.col("l_returnflag"), F.col("l_linestatus")))
    return decide.changed_only(h, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "payload").select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "payload")


@query("""WITH x AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') SELECT count(*) AS n_new FROM x WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_shipdate < TIMESTAMP '1998-01-01' AND o.l_partkey = x.l_partkey AND o.l_suppkey = x.l_suppkey AND o.l_returnflag = x.l_returnflag)""")
def append_by_fingerprint(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("fingerprint", decide.fingerprint(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return decide.append_new(li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)).agg(F.count("*").alias("n_new"))


@query("""WITH old AS (SELECT o_custkey, max(o_orderdate) AS at FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), new AS (SELECT o_custkey, max(o_orderdate) AS at FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, CAST(CAST(CASE WHEN o.at IS NULL OR n.at >= o.at THEN n.at ELSE o.at END AS DATE) AS VARCHAR) AS latest,
CASE WHEN o.at IS NULL THEN 'inserted' WHEN n.at IS NULL THEN 'unchanged' WHEN n.at >= o.at THEN 'replaced' ELSE 'kept' END AS action FROM old o FULL JOIN new n USING (o_custkey)""")
def scd_latest_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = lambda x: x.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    merged = decide.merge_latest(at(o.where("o_orderkey % 3 <> 0")), at(o.where("o_orderkey % 3 = 0")), ["o_custkey"], [F.desc("at")])
    return merged.select("o_custkey", F.col("at").cast("date").cast("string").alias("latest"), "action")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 49)")
def delete_orphans(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return decide.orphans(table(spark, sf_dir, "supplier"), refs, "s_suppkey").select("s_suppkey")


_SERIES = """ser AS (SELECT p_brand AS brand, strftime(l_shipdate, '%Y-%m') AS month, floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS price,
  max(l_discount) + 0.0 >= 0.1 AS heavy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
chg AS (SELECT * FROM (SELECT *, lag(price) OVER (PARTITION BY brand ORDER BY month) AS before FROM ser) WHERE abs(price - before) > 0),
ref AS (SELECT month, price AS reference FROM ser WHERE brand = 'Brand#1'),
imp AS (SELECT chg.*, reference, round(price - before, 4) AS delta, round(100 * (price - before) / abs(before), 2) AS delta_pct, round(reference - before, 2) AS gap_before, round(reference - price, 2) AS gap_after,
  CASE WHEN abs(price - before) < 1e-9 THEN 'neutral' WHEN (brand = 'Brand#1' AND price < before) OR (brand <> 'Brand#1' AND price > before) THEN 'favours_home' ELSE 'against_home' END AS direction FROM chg LEFT JOIN ref USING (month))"""


def _series(spark, sf_dir):
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.groupBy(F.col("p_brand").alias("brand"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        numbers.cents(dec("l_extendedprice") / dec("l_quantity")).alias("price"), (F.max("l_discount") + 0.0 >= 0.1).alias("heavy"))


def _impacts(spark, sf_dir):
    s = _series(spark, sf_dir)
    ref = s.where(F.col("brand") == m.HOME).select("month", F.col("price").alias("reference"))
    c = radar.changes(s, ["brand"], "month", "price").join(ref, "month", "left")
    return radar.impact(c, "before", "price", "reference", F.col("brand") == m.HOME)


@query(f"WITH {_SERIES} SELECT brand, month, before, price FROM chg")
def change_diff(spark, sf_dir):
    return radar.changes(_series(spark, sf_dir), ["brand"], "month", "price").select("brand", "month", "before", "price")


@query(f"WITH {_SERIES} SELECT brand, month, delta, delta_pct, gap_before, gap_after, direction, coalesce(abs(delta_pct) >= 0.5, false) AS material FROM imp")
def impact_delta_gap(spark, sf_dir):
    return _impacts(spark, sf_dir).select("brand", "month", "delta", "delta_pct", "gap_before", "gap_after", "direction", "material")


_RULES = """rules(rule, kind, weight, min_pct, max_pct, band_pct, min_amount, veto) AS (VALUES ('magnitude_high', 'delta', 45.0, 5.0, NULL, NULL, NULL, false), ('magnitude_medium', 'delta', 25.0, 2.0, 5.0, NULL, NULL, false), ('magnitude_low', 'delta', 10.0, 1.0, 2.0, NULL, NULL, false),
('table_noise', 'delta', 0.0, NULL, 1.0, NULL, NULL, true), ('band_entry', 'band_entry', 40.0, NULL, NULL, 5.0, NULL, false), ('band_exit', 'band_exit', 20.0, NULL, NULL, 5.0, NULL, false), ('gap_grew', 'gap', 20.0, NULL, NULL, NULL, 50.0, false), ('heavy_dimension', 'dimension', 20.0, NULL, NULL, NULL, NULL, false)),
met AS (SELECT imp.*, r.rule, r.weight, r.veto, coalesce(CASE r.kind WHEN 'delta' THEN coalesce(abs(delta_pct) >= min_pct, min_pct IS NULL) AND coalesce(abs(delta_pct) < max_pct, max_pct IS NULL)
  WHEN 'band_entry' THEN NOT (abs(before - reference) / abs(reference) * 100 <= band_pct) AND abs(price - reference) / abs(reference) * 100 <= band_pct
  WHEN 'band_exit' THEN abs(before - reference) / abs(reference) * 100 <= band_pct AND NOT (abs(price - reference) / abs(reference) * 100 <= band_pct)
  WHEN 'gap' THEN gap_after - gap_before >= min_amount WHEN 'dimension' THEN heavy END, false) AS f FROM imp CROSS JOIN rules r),
ev AS (SELECT brand, month, sum(weight) FILTER (f) AS p0, coalesce(array_to_string(list_sort(list(rule) FILTER (f)), ','), '') AS rules_fired, bool_or(f AND veto) AS vetoed, any_value(direction) AS direction, any_value(delta_pct) AS delta_pct FROM met GROUP BY ALL),
rk AS (SELECT *, CAST(coalesce(p0, 0) AS DOUBLE) AS points, CASE WHEN vetoed THEN 'NOISE' WHEN coalesce(p0, 0) >= 45 THEN 'HIGH' WHEN coalesce(p0, 0) >= 25 THEN 'MEDIUM' WHEN coalesce(p0, 0) >= 10 THEN 'LOW' ELSE 'NOISE' END AS band FROM ev),
que AS (SELECT *, CAST(CASE band WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1000 WHEN 'LOW' THEN 2000 ELSE 3000 END + 999 - points AS BIGINT) AS rank,
  CASE WHEN band = 'NOISE' THEN 'none' WHEN band = 'HIGH' AND direction = 'against_home' THEN 'review_price_today' WHEN band = 'HIGH' THEN 'update_argument_today' WHEN direction = 'against_home' THEN 'watch' ELSE 'note' END AS action FROM rk)"""


def _queue(spark, sf_dir):
    events = _impacts(spark, sf_dir).withColumnRenamed("price", "after").withColumn("key", F.concat_ws("/", "brand", "month"))
    q = radar.materiality(events, tables.literal(spark, radar.RULES, radar.RULE), "key")
    return q.withColumn("action", radar.reactions(F.col("band"), F.col("direction")))


@query(f"WITH {_SERIES}, {_RULES} SELECT brand, month, points, band, rank, rules_fired, '1' AS rules_version, action FROM que")
def materiality_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("brand", "month", "points", "band", "rank", "rules_fired", "rules_version", "action")


@query(f"WITH {_SERIES}, {_RULES} SELECT brand, month, band, rank FROM que WHERE band <> 'NOISE' ORDER BY rank, month, brand LIMIT 50")
def event_queue_page(spark, sf_dir):
    """A page of the queue: the fifty most pressing events."""
    return _queue(spark, sf_dir).where("band <> 'NOISE'").orderBy("rank", "month", "brand").limit(50).select("brand", "month", "band", "rank")


@query(f"""WITH {_SERIES}, {_RULES}, evi AS (SELECT p_brand AS brand, strftime(l_shipdate, '%Y-%m') AS month, arg_max(struct_pack(o := l_orderkey, s := l_suppkey), struct_pack(e := l_extendedprice, o := l_orderkey, l := l_linenumber)) AS top FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT que.brand, que.month, action, rules_fired, delta_pct, top.o AS evidence, s_name AS source FROM que JOIN evi USING (brand, month) JOIN supplier ON s_suppkey = top.s WHERE band = 'HIGH'""")
def why_chain(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    proof = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("brand"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.max_by(F.struct("l_orderkey", "l_suppkey"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("top"))
    s = table(spark, sf_dir, "supplier")
    return _queue(spark, sf_dir).where("band = 'HIGH'").join(proof, ["brand", "month"]).join(s, F.col("top.l_suppkey") == s.s_suppkey).select("brand", "month", "action", "rules_fired", "delta_pct", F.col("top.l_orderkey").alias("evidence"), F.col("s_name").alias("source"))


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')
SELECT l_partkey, 'appeared' AS event FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM a) UNION ALL SELECT l_partkey, 'disappeared' FROM a WHERE l_partkey NOT IN (SELECT l_partkey FROM b)""")
def lineup_changes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return radar.new_and_gone(li.where(F.col("l_shipdate") < at("1996-01-01")), li.where(F.col("l_shipdate") >= at("2001-01-01")), ["l_partkey"])


_RAW = ["1.234,5", "1.234", "5.8", "12.3456", "1.234.567", "R$ 499.000", "R$ 499.0002", "397 cv", "-5,5", "no number", "", "1234.5", "1.234.5", "12.345.6789", "285/70 R17", "V6", "4 em linha", "- 12"]
_VALUES = ", ".join("('" + r + "')" for r in _RAW)
_PARSE = """p AS (SELECT raw, regexp_extract(replace(raw, ' ', ''), '-?[0-9].*') AS rest FROM r),
n AS (SELECT raw, rest, coalesce(nullif(regexp_extract(rest, '^(-?[0-9]{1,3}(\\.[0-9]{3})+(,[0-9]+)?)([^0-9]|$)', 1), ''), nullif(regexp_extract(rest, '^-?[0-9]+,[0-9]+'), ''), nullif(regexp_extract(rest, '^-?[0-9]+\\.[0-9]+'), ''), nullif(regexp_extract(rest, '^-?[0-9]+'), '')) AS num FROM p),
v AS (SELECT raw, TRY_CAST(CASE WHEN contains(num, ',') THEN replace(replace(num, '.', ''), ',', '.') WHEN length(num) - length(replace(num, '.', '')) > 1 OR (length(num) - length(replace(num, '.', '')) = 1 AND length(split_part(num, '.', 1)) <= 3 AND length(split_part(num, '.', 2)) = 3) THEN replace(num, '.', '') ELSE num END AS DOUBLE) AS value FROM n)""".replace("\\\\", "\\")


@query(f"WITH r(raw) AS (VALUES {_VALUES}), {_PARSE} SELECT raw, value FROM v")
def parse_numbers_locale(spark, sf_dir):
    return tables.literal(spark, [(r,) for r in _RAW], "raw string").select("raw", numbers.parse_number(F.col("raw")).alias("value"))


@query("""SELECT p_partkey, CAST(round_even(p_size * 1.3596, 0) AS DOUBLE) AS power, CAST(round_even(p_size * 9.80665, 0) AS DOUBLE) AS torque, CAST(round_even(CASE WHEN p_size * 4 >= 100 THEN p_size * 4.0 ELSE p_size * 4 * 1000.0 END, 0) AS DOUBLE) AS length, CAST(round_even(p_size * 3.785411784, 3) AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS unknown FROM part""")
def unit_conversion(spark, sf_dir):
    size = F.col("p_size").cast("double")
    c = lambda v, u, d, n: numbers.convert(v, F.lit(u), d).alias(n)
    return table(spark, sf_dir, "part").select("p_partkey", c(size, "KW ", "power", "power"), c(size, "kgf.m", "torque", "torque"), c(size * 4, "m", "length", "length"), c(size, "gal", "volume", "volume"), c(size, "parsec", "length", "unknown"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_local, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS from_name, CAST(greatest(0, epoch(TIMESTAMP '1998-01-01' - o_orderdate) // 86400) AS BIGINT) AS age, CAST(year(o_orderdate) AS BIGINT) AS path_year FROM orders""")
def date_normalise(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    month = F.element_at(F.array(*map(F.lit, numbers.MONTHS)), F.month("o_orderdate"))
    named = F.when(F.col("o_orderkey") % 3 == 0, F.lit("sometime")).otherwise(F.concat(F.initcap(month), F.lit(" de "), F.year("o_orderdate").cast("string")))
    url = F.concat(F.lit("https://x.org/news/"), F.year("o_orderdate").cast("string"), F.lit("/a?y=2050"))
    return o.select("o_orderkey", numbers.iso_date(F.date_format("o_orderdate", "d/M/yyyy")).alias("from_local"), numbers.iso_date(named).alias("from_name"), numbers.age_days(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("age"), numbers.year_in_path(url).cast("bigint").alias("path_year"))
