"""Queries over sheets and their parts: arguments, ledgers, relevance, assembly, gaps, vocabulary, areas."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import compare, decide, extract, grid, quality, score, tables
from . import mapping as m
from .comparison import _FIT
from .decisions import _DECIDED, _ospec
from .registry import query, table

_WEIGHT = "CASE grp WHEN 'value' THEN 35.0 WHEN 'terms' THEN 25.0 WHEN 'record' THEN 20.0 WHEN 'body' THEN 12.0 ELSE 0.0 END"


@query(f"""WITH {_FIT.replace("(hn - lo) / nullif(hi - lo, 0)", "(hn - lo) / nullif(rg.hi - lo, 0)")},
pt AS (SELECT home, competitor, field, h0 > c0 AS good, row_number() OVER (PARTITION BY home, competitor, h0 > c0 ORDER BY {_WEIGHT} DESC, abs(h0 - c0) DESC, field) AS place FROM mine WHERE h0 IS NOT NULL AND c0 IS NOT NULL AND h0 <> c0)
SELECT home, competitor, field, good, place FROM pt WHERE place <= CASE WHEN good THEN 3 ELSE 1 END""")
def argument_points(spark, sf_dir):
    """At most three fields for the home side and one against it, by weight, then by difference."""
    known = m.long_facts(spark, sf_dir)
    s = score.field_scores(compare.align(known, m.pairs(spark, sf_dir), m.spec(spark)), score.ranges(known)).where("h_score <> c_score")
    profile = tables.literal(spark, score.weights(["value", "terms", "record", "body"], ["value", "terms", "record", "body"]), "grp string, weight double")
    s = s.join(profile, "grp").withColumn("good", F.col("h_score") > F.col("c_score"))
    best = tables.top_k(s, ["home", "competitor", "good"], [F.desc("weight"), F.desc(F.abs(F.col("h_score") - F.col("c_score"))), F.col("field")], 3)
    return best.where(F.col("good") | (F.col("place") == 1)).select("home", "competitor", "field", "good", F.col("place").cast("bigint").alias("place"))


@query("""WITH a AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS actual FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS provider, count(*) AS calls, count(actual) AS settled, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS estimated, CAST(sum(actual) AS DOUBLE) AS actual, CAST(sum(greatest(CAST(o_totalprice AS DECIMAL(18,2)), coalesce(actual, 0))) AS DOUBLE) AS accounted FROM orders LEFT JOIN a ON o_orderkey = l_orderkey GROUP BY 1""")
def budget_ledger(spark, sf_dir):
    """Estimated, actual and accounted sums in decimals; what is not settled counts as estimated."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("actual"))
    o = table(spark, sf_dir, "orders").withColumn("est", F.col("o_totalprice").cast("decimal(18,2)"))
    j = o.join(a, o.o_orderkey == a.l_orderkey, "left")
    s = lambda c: F.sum(c).cast("double")
    return j.groupBy(F.col("o_orderpriority").alias("provider")).agg(F.count("*").alias("calls"), F.count("actual").alias("settled"), s("est").alias("estimated"), s("actual").alias("actual"), s(F.greatest("est", F.coalesce("actual", F.lit(0)))).alias("accounted"))


_TERMS = ["the", "nicht", "les", "que"]


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT doc_id, pos, (contains(lower(line), 'the'))::INT + (contains(lower(line), 'nicht'))::INT + (contains(lower(line), 'les'))::INT + (contains(lower(line), 'que'))::INT AS score FROM l)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(score AS BIGINT) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM s WHERE score > 0) WHERE place <= 3""")
def relevance_blocks(spark, sf_dir):
    """The three lines of each text that name most of the terms still sought."""
    hits = sum((F.contains(F.lower("line"), F.lit(t)).cast("bigint") for t in _TERMS), F.lit(0).cast("bigint"))
    s = extract.lines(table(spark, sf_dir, "documents")).withColumn("score", hits).where("score > 0")
    return tables.top_k(s, ["doc_id"], [F.desc("score"), F.col("pos")], 3).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "score", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {_DECIDED}, dec AS (SELECT entity, field, CASE WHEN agree THEN 'verified' ELSE 'divergent' END AS status, low AS value FROM conf)
SELECT p_partkey AS entity, coalesce(max(value) FILTER (field = 'unit_price'), p_retailprice) AS price, CASE WHEN max(value) FILTER (field = 'unit_price') IS NULL THEN 'catalogue' ELSE 'evidence' END AS price_origin, coalesce(max(status) FILTER (field = 'discount'), 'not_found') AS discount_status, p_brand || ' ' || p_type AS label
FROM part LEFT JOIN dec ON entity = p_partkey GROUP BY p_partkey, p_retailprice, p_brand, p_type""")
def assemble_sheet(spark, sf_dir):
    """One row for each part: decided values, the catalogue's where there is no evidence, marked as such."""
    d = decide.decide(m.observations(spark, sf_dir), _ospec(spark)).where(F.col("field").isin("unit_price", "discount"))
    wide = d.groupBy("entity").agg(F.max(F.when(F.col("field") == "unit_price", F.col("value"))).alias("v"), F.max(F.when(F.col("field") == "discount", F.col("status"))).alias("s"))
    j = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "entity").join(wide, "entity", "left")
    return j.select("entity", F.coalesce("v", "p_retailprice").alias("price"), F.when(F.col("v").isNull(), "catalogue").otherwise("evidence").alias("price_origin"), F.coalesce("s", F.lit("not_found")).alias("discount_status"), F.concat_ws(" ", "p_brand", "p_type").alias("label"))


@query(f"""WITH {m.OBS}, s AS (SELECT entity, count(*) AS n, min(tier) AS best, max(ts) AS last FROM obs WHERE field = 'tax' AND num = 0 GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'nobody_says_so' WHEN best > 2 THEN 'only_unofficial_sources' WHEN last < TIMESTAMP '1998-01-01' THEN 'too_old' ELSE 'answered' END AS reason FROM part LEFT JOIN s ON entity = p_partkey""")
def gap_diagnosis(spark, sf_dir):
    """Why a field has no answer: the first reason that holds."""
    o = m.observations(spark, sf_dir).where("field = 'tax' and num = 0").groupBy("entity").agg(F.count("*").alias("n"), F.min("tier").alias("best"), F.max("ts").alias("last"))
    j = table(spark, sf_dir, "part").select("p_partkey").join(o, F.col("p_partkey") == F.col("entity"), "left")
    rules = [("nobody_says_so", "open", F.col("n").isNull()), ("only_unofficial_sources", "open", F.col("best") > 2), ("too_old", "open", F.col("last") < F.lit("1998-01-01").cast("timestamp_ntz"))]
    return quality.first_rule(j, rules, ("answered", "closed")).select("p_partkey", F.col("rule").alias("reason"))


_WORDS = [("kind", "economy", "entry"), ("kind", "promo", "entry"), ("kind", "standard", "core"), ("kind", "medium", "core")]


@query("SELECT p_partkey, coalesce(CASE lower(p_type) WHEN 'economy' THEN 'entry' WHEN 'promo' THEN 'entry' WHEN 'standard' THEN 'core' WHEN 'medium' THEN 'core' END, lower(p_type)) AS canonical FROM part")
def synonym_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("kind").alias("field"), "p_type")
    return grid.canonical(p, tables.literal(spark, _WORDS, "field string, token string, canonical string"), "field", F.col("p_type")).select("p_partkey", "canonical")


@query(f"""WITH {_DECIDED}, tr AS (SELECT entity, field, CASE WHEN agree THEN 'verified' ELSE 'divergent' END AS got, CASE WHEN entity % 2 = 0 THEN 'verified' ELSE 'divergent' END AS want FROM conf),
ok AS (SELECT * FROM (VALUES ('verified', 'verified'), ('divergent', 'divergent'), ('divergent', 'verified')) v(want, got)) SELECT field, count(*) AS n, count(ok.got) AS compatible, round(count(ok.got) / CAST(count(*) AS DOUBLE), 4) AS fidelity FROM tr LEFT JOIN ok USING (want, got) GROUP BY 1""")
def status_fidelity(spark, sf_dir):
    """Decided states against the states that a truth table allows."""
    allowed = tables.literal(spark, [("verified", "verified"), ("divergent", "divergent"), ("divergent", "verified")], "want string, status string").withColumn("ok", F.lit(1))
    d = decide.decide(m.observations(spark, sf_dir), _ospec(spark)).withColumn("want", F.when(F.col("entity") % 2 == 0, "verified").otherwise("divergent"))
    g = d.join(allowed, ["want", "status"], "left").groupBy("field").agg(F.count("*").alias("n"), F.count("ok").alias("compatible"))
    return g.withColumn("fidelity", tables.ratio(F.col("compatible"), F.col("n")))


@query("""SELECT conv_id, count(*) AS n, string_agg(role, ' > ' ORDER BY turn) AS trail, max(turn) - min(turn) + 1 - count(*) AS missing_turns FROM conversations GROUP BY 1""")
def event_trail(spark, sf_dir):
    """The ordered trail of each conversation; its turns are few, so they may meet in one row."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("missing_turns"))
    return g.select("conv_id", "n", F.array_join(F.col("t.role"), " > ").alias("trail"), "missing_turns")


@query("""WITH g AS (SELECT p_brand, p_size // 10 AS band, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY band) AS k, count(*) OVER (PARTITION BY p_brand) AS of FROM g)
SELECT p_brand, CAST(band AS BIGINT) AS band, n, round((k - 1) * 10 / CAST(greatest(of - 1, 1) AS DOUBLE), 2) AS score FROM s""")
def ordinal_scaling(spark, sf_dir):
    """Place in the order of bands, 0 to 10."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_size") / 10).alias("band")).agg(F.count("*").alias("n"))
    by = W.partitionBy("p_brand")
    k, of = F.row_number().over(by.orderBy("band")), F.count("*").over(by)
    return g.select("p_brand", "band", "n", F.round((k - 1) * 10 / F.greatest(of - 1, F.lit(1)), 2).alias("score"))


@query("""WITH b AS (SELECT p_partkey % 50 AS page, p_size AS x0, p_partkey % 13 AS y0 FROM part), u AS (SELECT DISTINCT page, x0 + i AS x, y0 + j AS y FROM b, range(5) a(i), range(3) c(j))
SELECT page, CAST(count(*) AS DOUBLE) AS area FROM u WHERE x IS NOT NULL GROUP BY page""")
def area_union(spark, sf_dir):
    """Area that the boxes (size, key) of each part's neighbours cover; the SQL counts unit squares."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("page"), F.col("p_size").cast("double").alias("x0"), (F.col("p_partkey") % 13).cast("double").alias("y0"))
    return grid.area_of_union(p.withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 3), "page")
