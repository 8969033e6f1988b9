"""Queries that compare parts: parity, matrices, comparability, scores, scenarios, export."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import compare, facts, score, tables
from . import mapping as m
from .registry import query, table


def _aligned(spark, sf_dir):
    return compare.align(m.long_facts(spark, sf_dir), m.pairs(spark, sf_dir), m.spec(spark))


@query(f"WITH {m.ALIGNED}, {m.parity_sql()} SELECT home, competitor, brand, field, state, reason, difference FROM par")
def parity_matrix(spark, sf_dir):
    return compare.parity(_aligned(spark, sf_dir)).select("home", "competitor", "brand", "field", "state", "reason", "difference")


@query(f"""WITH {m.ALIGNED}, {m.parity_sql()} SELECT brand, grp, count(*) FILTER (state = 'advantage') AS n_advantage, count(*) FILTER (state = 'parity') AS n_parity,
count(*) FILTER (state = 'gap') AS n_gap, count(*) FILTER (state = 'unknown') AS n_unknown, count(*) AS n_fields, count(*) FILTER (state <> 'unknown') AS comparable FROM par GROUP BY ALL""")
def parity_counts(spark, sf_dir):
    return compare.state_counts(compare.parity(_aligned(spark, sf_dir)), "brand", "grp")


@query("""WITH s AS (SELECT p_brand AS brand, list_sort(list(DISTINCT p_type)) AS kinds, list_sort(list(DISTINCT p_size // 10)) AS bands FROM part GROUP BY 1),
h AS (SELECT kinds AS hk, bands AS hb FROM s WHERE brand = 'Brand#1'),
x AS (SELECT brand, len(list_filter(hb, lambda x: NOT list_contains(bands, x))) AS more, len(list_filter(bands, lambda x: NOT list_contains(hb, x))) AS less,
  len(list_filter(hk, lambda x: NOT list_contains(kinds, x))) AS kmore, len(list_filter(kinds, lambda x: NOT list_contains(hk, x))) AS kless, CAST(len(list_intersect(hb, bands)) AS BIGINT) AS shared FROM s, h WHERE brand <> 'Brand#1')
SELECT brand, CASE WHEN more = 0 AND less = 0 THEN 'equal' WHEN less = 0 THEN 'superset' WHEN more = 0 THEN 'subset' ELSE 'crossing' END AS bands,
CASE WHEN kmore = 0 AND kless = 0 THEN 'equal' WHEN kless = 0 THEN 'superset' WHEN kmore = 0 THEN 'subset' ELSE 'crossing' END AS kinds, shared FROM x""")
def set_parity(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias("kinds"), F.collect_set(F.floor(F.col("p_size") / 10)).alias("bands"))
    h = s.where(F.col("brand") == m.HOME).select(F.col("kinds").alias("hk"), F.col("bands").alias("hb"))
    x = s.where(F.col("brand") != m.HOME).crossJoin(F.broadcast(h))  # h: one brand, so one row
    return x.select("brand", compare.set_relation(F.col("hb"), F.col("bands")).alias("bands"), compare.set_relation(F.col("hk"), F.col("kinds")).alias("kinds"), F.size(F.array_intersect("hb", "bands")).cast("bigint").alias("shared"))


_BRAND = """b AS (SELECT p_brand AS brand, p_type AS kind, floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS price
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)"""


def _brand_prices(spark, sf_dir):
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return part.join(li, part.p_partkey == li.l_partkey).groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(numbers.cents(dec("l_extendedprice") / dec("l_quantity")).alias("price"))


@query(f"""WITH {_BRAND}, h AS (SELECT kind, price AS hp FROM b WHERE brand = 'Brand#1'), r AS (SELECT DISTINCT brand FROM b WHERE brand <> 'Brand#1'), k AS (SELECT DISTINCT kind FROM b),
x AS (SELECT r.brand, k.kind, b.price, hp FROM r CROSS JOIN k LEFT JOIN b ON b.brand = r.brand AND b.kind = k.kind LEFT JOIN h ON h.kind = k.kind),
y AS (SELECT brand, kind, price, CASE WHEN price IS NULL AND hp IS NULL THEN false WHEN price IS NULL OR hp IS NULL THEN true ELSE NOT (abs(price - hp) <= 0.02 * abs(hp)) END AS d FROM x)
SELECT brand, max(price) FILTER (kind = 'ECONOMY') AS economy, max(price) FILTER (kind = 'LARGE') AS large, max(price) FILTER (kind = 'PROMO') AS promo, count(*) FILTER (d) AS n_different FROM y GROUP BY brand""")
def comparison_matrix_pivot(spark, sf_dir):
    b = _brand_prices(spark, sf_dir)
    h = b.where(F.col("brand") == m.HOME).select("kind", F.col("price").alias("hp"))
    grid = b.where(F.col("brand") != m.HOME).select("brand").distinct().crossJoin(tables.if_small(b.select("kind").distinct()))
    x = grid.join(b, ["brand", "kind"], "left").join(h, "kind", "left")
    d = compare.differs(F.col("hp"), F.col("price"), F.lit(None).cast("double"), F.lit(0.02))
    n = x.groupBy("brand").agg(F.count_if(d).alias("n_different"))
    wide = x.groupBy("brand").pivot("kind", ["ECONOMY", "LARGE", "PROMO"]).agg(F.max("price"))
    return wide.join(n, "brand").select("brand", F.col("ECONOMY").alias("economy"), F.col("LARGE").alias("large"), F.col("PROMO").alias("promo"), "n_different")


_SIDES = f"""{m.SHEET}, {m.PAIRS},
x AS (SELECT home, competitor, brand, h.p_size AS hs, c.p_size AS cs, h.unit_price AS hu, c.unit_price AS cu, h.p_retailprice AS hp, c.p_retailprice AS cp, h.flags AS hf, c.flags AS cf, h.returned AS hr, c.returned AS cr, h.p_name AS hn, c.p_name AS cn
  FROM pair JOIN sheet h ON h.p_partkey = home JOIN sheet c ON c.p_partkey = competitor),
k AS (SELECT *, [cr = hr, abs(cs - hs) / abs(hs) * 100 <= 30, abs(cu - hu) / abs(hu) * 100 <= 15, abs(cp - hp) / abs(hp) * 100 <= 5, list_has_any(hf, cf), cn = hn] AS c FROM x),
s AS (SELECT *, len(list_filter(c, lambda v: v)) AS met, len(list_filter(c, lambda v: v IS NOT NULL)) AS evaluable FROM k),
z AS (SELECT *, met >= 4 AND NOT coalesce(NOT c[1], false) AS comparable FROM s)"""
_CRITERIA = [("returned", "equal", "h_returned", "c_returned", None, True), ("size", "band", "h_p_size", "c_p_size", 30, False), ("unit_price", "band", "h_unit_price", "c_unit_price", 15, False), ("price", "band", "h_p_retailprice", "c_p_retailprice", 5, False), ("flags", "shared", "h_flags", "c_flags", None, False), ("name", "equal", "h_p_name", "c_p_name", None, False)]


def _scored_pairs(spark, sf_dir):
    sheet = m.sheet(spark, sf_dir).select("p_partkey", "returned", "p_size", "unit_price", "p_retailprice", "flags", "p_name")
    side = lambda p, key: sheet.select(*[F.col(c).alias(key if c == "p_partkey" else p + c) for c in sheet.columns])
    p = m.pairs(spark, sf_dir).join(side("h_", "home"), "home").join(side("c_", "competitor"), "competitor")
    return compare.comparability(p, _CRITERIA)


@query(f"WITH {_SIDES} SELECT home, competitor, CAST(met AS BIGINT) AS met, CAST(evaluable AS BIGINT) AS evaluable, CAST(6 AS BIGINT) AS total, comparable, array_to_string(list_filter(list_transform(['returned', 'size', 'unit_price', 'price', 'flags', 'name'], lambda n, i: CASE WHEN NOT c[i] THEN n END), lambda n: n IS NOT NULL), ',') AS unmet FROM z")
def comparability_k_of_n(spark, sf_dir):
    return _scored_pairs(spark, sf_dir).select("home", "competitor", "met", "evaluable", "total", "comparable", "unmet")


@query(f"""WITH {_SIDES}, o AS (SELECT DISTINCT home FROM pair), b AS (SELECT DISTINCT brand FROM pair),
r AS (SELECT *, row_number() OVER (PARTITION BY home, brand ORDER BY met DESC, abs(cp - hp), competitor) AS n FROM z WHERE comparable)
SELECT o.home, b.brand, r.competitor, CAST(coalesce(r.met, 0) AS BIGINT) AS met, CASE WHEN r.competitor IS NULL THEN 'no_comparable' ELSE '' END AS reason FROM o CROSS JOIN b LEFT JOIN r ON r.home = o.home AND r.brand = b.brand AND n = 1""")
def benchmark_proposal(spark, sf_dir):
    s = _scored_pairs(spark, sf_dir)
    best = compare.best_match(s.where("comparable"), ["home", "brand"], [F.col("met").desc(), F.abs(F.col("c_p_retailprice") - F.col("h_p_retailprice")), F.col("competitor")])
    every = s.select("home").distinct().crossJoin(tables.if_small(s.select("brand").distinct()))
    out = every.join(best.select("home", "brand", "competitor", "met"), ["home", "brand"], "left")
    return out.select("home", "brand", "competitor", F.coalesce("met", F.lit(0)).cast("bigint").alias("met"), F.when(F.col("competitor").isNull(), "no_comparable").otherwise("").alias("reason"))


_AFTER = m.ALIGNED + """, changed AS (SELECT * REPLACE (CASE WHEN field = 'unit_price' AND cn IS NOT NULL THEN round(cn * (1 + -10.0 / 100), 2) WHEN field = 'size' AND cn IS NOT NULL AND competitor % 3 = 0 THEN 25.0 ELSE cn END AS cn) FROM aligned)"""


@query(f"""WITH {_AFTER}, {m.parity_sql()}, {m.parity_sql('changed', 'par2')}
SELECT a.home, a.competitor, a.field, a.state AS state_before, b.state AS state_after FROM par a JOIN par2 b ON a.home = b.home AND a.competitor = b.competitor AND a.field = b.field WHERE a.state <> b.state""")
def scenario_overlay_diff(spark, sf_dir):
    known, pairs, spec = m.long_facts(spark, sf_dir), m.pairs(spark, sf_dir), m.spec(spark)
    none = F.lit(None).cast("double")
    others = pairs.select(F.col("competitor").alias("entity")).distinct()
    overrides = others.select("entity", F.lit("unit_price").alias("field"), F.lit(-10.0).alias("pct"), none.alias("value")).unionByName(
        others.where(F.col("entity") % 3 == 0).select("entity", F.lit("size").alias("field"), none.alias("pct"), F.lit(25.0).alias("value")))
    before = compare.parity(compare.align(known, pairs, spec))
    after = compare.parity(compare.align(compare.overlay(known, overrides), pairs, spec))
    return compare.changed_states(before, after, ["home", "competitor", "field"])


_CELLS = """CASE WHEN num IS NOT NULL THEN printf('%.2f', num) WHEN flag THEN 'yes' WHEN NOT flag THEN 'no' WHEN len(items) > 0 THEN array_to_string(items, ', ') WHEN trim(coalesce(txt, '')) <> '' THEN trim(txt) ELSE 'not found' END"""


@query(f"WITH {m.FACTS} SELECT entity, field, {_CELLS} AS cell, CASE WHEN status = 'not_found' THEN 'no data' ELSE 'fact' END AS label FROM fact")
def export_long(spark, sf_dir):
    return compare.export_long(m.long_facts(spark, sf_dir))


@query(f"WITH {m.FACTS}, l AS (SELECT entity, field, {_CELLS} AS cell FROM fact) SELECT entity, max(cell) FILTER (field = 'price') AS price, max(cell) FILTER (field = 'unit_price') AS unit_price, max(cell) FILTER (field = 'flags') AS flags FROM l GROUP BY entity")
def export_status_words(spark, sf_dir):
    long = compare.export_long(m.long_facts(spark, sf_dir))
    return compare.matrix(long.where(F.col("field").isin("price", "unit_price", "flags")), "entity", ["price", "unit_price", "flags"])


@query(f"WITH {m.FACTS} SELECT entity, field, CASE WHEN field IN ('price', 'kind') THEN num END AS num, CASE WHEN field IN ('price', 'kind') THEN txt END AS txt, CASE WHEN field IN ('price', 'kind') THEN status ELSE 'unverified' END AS status FROM fact")
def projection_as_null(spark, sf_dir):
    return facts.requested(m.long_facts(spark, sf_dir), ["price", "kind"]).select("entity", "field", "num", "txt", "status")


@query(f"WITH {m.FACTS} SELECT field, min(num) AS low, max(num) AS high, count(DISTINCT num) AS n_values, count(DISTINCT num) < 2 AS insufficient FROM fact WHERE num IS NOT NULL GROUP BY field")
def numeric_ranges(spark, sf_dir):
    return score.ranges(m.long_facts(spark, sf_dir))


@query(f"""WITH {m.SHEET}, r AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM sheet GROUP BY 1)
SELECT p_partkey, round(10 * (1 - least(1.0, greatest(0.0, (p_retailprice - lo) / nullif(hi - lo, 0)))), 2) AS score FROM sheet JOIN r USING (p_brand)""")
def min_max_scaling(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    by = W.partitionBy("p_brand")
    return p.select("p_partkey", score.scaled(F.col("p_retailprice"), F.min("p_retailprice").over(by), F.max("p_retailprice").over(by), F.lit("low")).alias("score"))


@query("SELECT dimension, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('value', 35.0), ('terms', 25.0), ('record', 20.0), ('body', 0.0)) t(dimension, weight)")
def rank_weights(spark, sf_dir):
    return tables.literal(spark, score.weights(["value", "terms", "record"], ["value", "terms", "body", "record"]), "dimension string, weight double")


_FIT = m.ALIGNED + """, rg AS (SELECT field, min(num) AS lo, max(num) AS hi, count(DISTINCT num) < 2 AS short FROM fact WHERE num IS NOT NULL GROUP BY field),
mine AS (SELECT a.*, rg.short,
  CASE WHEN kind = 'number' AND hn IS NOT NULL THEN CASE WHEN coalesce(short, true) THEN 5.0 ELSE round(10 * CASE WHEN direction = 'low' THEN 1 - least(1.0, greatest(0.0, (hn - lo) / nullif(hi - lo, 0))) ELSE least(1.0, greatest(0.0, (hn - lo) / nullif(hi - lo, 0))) END, 2) END
       WHEN kind = 'bool' AND hb IS NOT NULL THEN CASE WHEN hb THEN 10.0 ELSE 0.0 END WHEN kind = 'list' AND len(a.hi) > 0 THEN round(least(len(a.hi), 7) * 10.0 / 7, 2) END AS h0,
  CASE WHEN kind = 'number' AND cn IS NOT NULL THEN CASE WHEN coalesce(short, true) THEN 5.0 ELSE round(10 * CASE WHEN direction = 'low' THEN 1 - least(1.0, greatest(0.0, (cn - lo) / nullif(rg.hi - lo, 0))) ELSE least(1.0, greatest(0.0, (cn - lo) / nullif(rg.hi - lo, 0))) END, 2) END
       WHEN kind = 'bool' AND cb IS NOT NULL THEN CASE WHEN cb THEN 10.0 ELSE 0.0 END WHEN kind = 'list' AND len(a.ci) > 0 THEN round(least(len(a.ci), 7) * 10.0 / 7, 2) END AS c0
  FROM aligned a LEFT JOIN rg USING (field)),
sc AS (SELECT home, competitor, grp, CASE WHEN h0 IS NOT NULL AND c0 IS NOT NULL THEN h0 END AS h, CASE WHEN h0 IS NOT NULL AND c0 IS NOT NULL THEN c0 END AS c FROM mine),
dm AS (SELECT home, competitor, grp, floor((CAST(sum(CAST(h AS DECIMAL(10,2))) AS DOUBLE) / count(h)) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS h, floor((CAST(sum(CAST(c AS DECIMAL(10,2))) AS DOUBLE) / count(h)) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS c FROM sc GROUP BY ALL HAVING count(h) > 0 AND count(h) >= 0.5 * count(*)),
w AS (SELECT *, coalesce(CASE grp WHEN 'value' THEN 35.0 WHEN 'terms' THEN 25.0 WHEN 'record' THEN 20.0 WHEN 'body' THEN 12.0 END, 0.0) AS weight FROM dm)"""


@query(f"""WITH {_FIT.replace("(hn - lo) / nullif(hi - lo, 0)", "(hn - lo) / nullif(rg.hi - lo, 0)")}
SELECT home, competitor, floor((CAST(sum(CAST(floor((h * weight::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(weight) AS DOUBLE), 0)) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS h_fit, floor((CAST(sum(CAST(floor((c * weight::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(weight) AS DOUBLE), 0)) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS c_fit,
CAST(sum(weight) AS DOUBLE) AS considered_weight, count(*) AS n_dimensions, count(*) FILTER (h > c) AS h_wins FROM w GROUP BY ALL""")
def fit_score_pairs(spark, sf_dir):
    known = m.long_facts(spark, sf_dir)
    scored = score.field_scores(compare.align(known, m.pairs(spark, sf_dir), m.spec(spark)), score.ranges(known))
    dims = m.spec(spark).select("field", F.col("grp").alias("dimension"))
    profile = tables.literal(spark, score.weights(["value", "terms", "record", "body"], ["value", "terms", "record", "body"]), "dimension string, weight double")
    return score.fit(scored.drop("grp"), dims, profile, ["home", "competitor"])


@query(f"""WITH {m.SHEET}, {m.PAIRS}, c AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN round(p_size * 0.55 + n_items * 0.45, 2) END AS use, unit_price FROM sheet),
k AS (SELECT p_partkey, round(1000.0 / use * unit_price, 2) AS cost, concat_ws(',', CASE WHEN use IS NULL THEN 'consumption' END, CASE WHEN unit_price IS NULL THEN 'price' END) AS lacking FROM c)
SELECT home, competitor, h.cost AS home_cost, c.cost AS competitor_cost, round(c.cost - h.cost, 2) AS monthly, round((c.cost - h.cost) * 12, 2) AS annual, c.lacking FROM pair JOIN k h ON h.p_partkey = home JOIN k c ON c.p_partkey = competitor""")
def cost_of_use(spark, sf_dir):
    from ..functions.numbers import combined_consumption

    s = m.sheet(spark, sf_dir).withColumn("use", F.when(F.col("p_size") > 3, combined_consumption(F.col("p_size"), F.col("n_items"))))
    k = score.cost_of_use(s, F.lit(1000.0), F.col("use"), F.col("unit_price")).select("p_partkey", "cost", "lacking")
    p = m.pairs(spark, sf_dir).join(k.select(F.col("p_partkey").alias("home"), F.col("cost").alias("home_cost")), "home").join(k.select(F.col("p_partkey").alias("competitor"), F.col("cost").alias("competitor_cost"), "lacking"), "competitor")
    gap = F.col("competitor_cost") - F.col("home_cost")
    return p.select("home", "competitor", "home_cost", "competitor_cost", F.round(gap, 2).alias("monthly"), F.round(gap * 12, 2).alias("annual"), "lacking")


@query(f"""WITH {m.SHEET}, i AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice + p_partkey % 7 END AS inside, p_retailprice AS outside FROM sheet)
SELECT p_partkey, inside, outside, round(inside - outside, 2) AS gap FROM i WHERE inside IS NOT NULL AND NOT (abs(outside - inside) <= 0.003 * abs(inside))""")
def internal_vs_public(spark, sf_dir):
    from ..functions.numbers import close

    s = m.sheet(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice") + F.col("p_partkey") % 7).alias("inside"), F.col("p_retailprice").alias("outside"))
    return s.where(F.col("inside").isNotNull() & ~close(F.col("inside"), F.col("outside"), F.lit(None).cast("double"), F.lit(0.003))).select("p_partkey", "inside", "outside", F.round(F.col("inside") - F.col("outside"), 2).alias("gap"))
