"""Queries of audits: exposure of a truth set, published values against proof and truth, what a scenario moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, compare, quality, score, tables
from . import mapping as m
from .comparison import _AFTER, _FIT
from .registry import query, table

_MODEL = """b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, text FROM benchmark WHERE text IS NOT NULL), f AS (SELECT item_id AS family, ' ' || w[3] || ' ' || w[4] || ' ' AS needle, ' ' || w[3] || w[4] || ' ' AS joined FROM b WHERE len(w) >= 4),
u AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM b WHERE item_id % 4 = 0), d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents)"""


def _families(spark, sf_dir):
    """The third and fourth word of every benchmark item as a model's name."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return b.where(F.size("w") >= 4).select(F.col("item_id").alias("family"), F.concat_ws("-", F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("model"))


@query(f"""WITH {_MODEL}, p AS (SELECT family, count(*) AS n FROM f JOIN u ON contains(t, needle) OR contains(t, joined) GROUP BY 1), s AS (SELECT family, count(*) AS n FROM f JOIN d ON contains(t, needle) OR contains(t, joined) GROUP BY 1)
SELECT family, coalesce(p.n, 0) AS n_prior, coalesce(s.n, 0) AS n_mentions, CASE WHEN p.n > 0 THEN 'used_before' ELSE 'review_pending' END AS status FROM f LEFT JOIN p USING (family) LEFT JOIN s USING (family)""")
def exposure_audit(spark, sf_dir):
    """Which families of a truth set earlier tests aimed at, and how many documents mention them."""
    used = table(spark, sf_dir, "benchmark").where("item_id % 4 = 0").select(F.col("item_id").alias("id"), F.col("text").alias("target"))
    return audit.exposure(_families(spark, sf_dir), used, table(spark, sf_dir, "documents"))


_CLAIMS = """l AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS k, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey AS entity, 'quantity_' || l_linenumber AS field, k, CASE WHEN k % 23 = 0 THEN NULL WHEN s = 1 AND k % 4 = 0 THEN q + 1 ELSE q END AS num, CASE WHEN k % 17 = 0 THEN 'divergent' WHEN k % 5 = 0 THEN 'unverified' ELSE 'verified' END AS status,
  CASE WHEN k % 7 = 0 THEN 'text_changed' WHEN k % 11 = 0 THEN 'quote_not_found' WHEN k % 3 = 0 THEN 'ordered_apart' WHEN k % 13 = 0 OR s = 1 AND k % 4 = 0 THEN 'number_not_in_quote' END AS reason0 FROM l, range(2) AS r(s) WHERE s = 0 OR k % 2 = 0),
p AS (SELECT *, CASE WHEN reason0 = 'number_not_in_quote' AND num IS NULL THEN NULL ELSE reason0 END AS reason FROM c),
g AS (SELECT entity, field, any_value(k) AS k, count(num) AS n_values, count(*) FILTER (num IS NOT NULL AND reason IS NULL) AS n_valid, min(num) AS lo, max(num) AS hi, bool_or(status = 'divergent') AS dv, coalesce(bool_and(status = 'verified') FILTER (num IS NOT NULL), false) AS vf FROM p GROUP BY entity, field),
w AS (SELECT DISTINCT l_orderkey AS entity, 'quantity_' || n AS field FROM lineitem, range(1, 9) AS r(n) WHERE n <= 8),
t AS (SELECT l_orderkey AS entity, 'quantity_' || l_linenumber AS field, CASE WHEN k % 19 = 0 THEN q + 5 ELSE q END AS truth FROM l WHERE k % 6 <> 1),
a AS (SELECT entity, field, coalesce(n_values, 0) AS n_values, coalesce(n_valid, 0) AS n_valid, coalesce(dv OR lo <> hi, false) AS cf, coalesce(lo = truth, false) AND NOT coalesce(dv OR lo <> hi, false) AS matches, coalesce(vf, false) AS vf FROM w LEFT JOIN g USING (entity, field) LEFT JOIN t USING (entity, field)),
f AS (SELECT entity, field, n_values, n_valid, matches, CASE WHEN cf THEN 'conflict' WHEN n_values = 0 THEN 'unknown' WHEN n_valid = 0 THEN 'no_proof' WHEN NOT vf THEN 'not_verified' WHEN matches THEN 'correct' ELSE 'truth_lacking_or_different' END AS result FROM a)"""


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_shipdate").alias("l_shipdate"))
    return li.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("field", F.concat(F.lit("quantity_"), F.col("l_linenumber").cast("string")))


def _proved(spark, sf_dir):
    """Published quantities of every line of an order, some from a second reading, with the proof of each."""
    li, k = _lines(spark, sf_dir), F.col("k")
    whole = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit("Delivery note "), k.cast("string"), F.lit("\nordered "), whole, F.lit(" pieces, shipped "), F.date_format("l_shipdate", "MMMM"))
    digest = F.sha2(F.when(k % 7 == 0, F.concat(text, F.lit(" "))).otherwise(text), 256)
    texts = li.select(k.alias("source"), text.alias("text"), digest.alias("sha256"))
    quote = F.when(k % 11 == 0, F.concat(F.lit("zxqj wvky "), whole)).when((k % 13 == 0) & (k % 7 != 0), "pieces, shipped").otherwise(F.concat(F.lit("ordered  "), whole, F.lit(" pieces")))
    two = li.withColumn("s", F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    num = F.when(k % 23 == 0, None).when((F.col("s") == 1) & (k % 4 == 0), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    status = F.when(k % 17 == 0, "divergent").when(k % 5 == 0, "unverified").otherwise("verified")
    claims = two.select(F.col("l_orderkey").alias("entity"), "field", num.alias("num"), quote.alias("quote"), k.alias("source"), status.alias("status"))
    return audit.proofs(claims, texts, F.when(F.col("source") % 3 == 0, "ordered_apart"))


def _audited(spark, sf_dir):
    li = _lines(spark, sf_dir)
    wanted = li.select(F.col("l_orderkey").alias("entity")).distinct().withColumn("field", F.explode(F.array(*[F.lit(f"quantity_{n}") for n in range(1, 9)])))
    truth = li.where(F.col("k") % 6 != 1).select(F.col("l_orderkey").alias("entity"), "field", F.when(F.col("k") % 19 == 0, F.col("l_quantity") + 5).otherwise(F.col("l_quantity")).alias("num"))
    return audit.audited(wanted, _proved(spark, sf_dir), truth)


@query(f"WITH {_CLAIMS} SELECT * FROM f")
def published_audit(spark, sf_dir):
    """Every field wanted of every order: conflict, unknown, without proof, not verified, correct, or beside the truth."""
    return _audited(spark, sf_dir)


@query(f"""WITH {_CLAIMS}, s AS (SELECT entity, count(*) AS wanted, count(*) FILTER (result = 'correct') AS correct, count(*) FILTER (result = 'conflict') AS conflicts, count(*) FILTER (result IN ('correct', 'truth_lacking_or_different')) AS supported, count(*) FILTER (matches) AS matches FROM f GROUP BY 1)
SELECT *, round(correct / wanted, 4) AS correct_share, correct >= 0.25 * wanted AS met FROM s""")
def audit_by_entity(spark, sf_dir):
    """Each order's audit in numbers, and whether a quarter of what is wanted is correct."""
    return audit.audit_summary(_audited(spark, sf_dir), 0.25)


@query(f"WITH {_CLAIMS} SELECT field, reason, count(*) AS n FROM p WHERE reason IS NOT NULL GROUP BY ALL")
def proof_failures(spark, sf_dir):
    """Failed proofs by field and reason."""
    return audit.failures_by_field(_proved(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT c_mktsegment AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS field FROM customer WHERE c_mktsegment <> 'BUILDING' UNION SELECT 'BUILDING', NULL),
h AS (SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS field FROM customer WHERE c_acctbal > 5000)
SELECT w.segment, count(w.field) AS wanted, count(h.field) AS settled, round(count(h.field) / nullif(count(w.field), 0), 4) AS rate FROM w LEFT JOIN h ON h.segment = w.segment AND h.field = w.field GROUP BY 1""")
def settled_rate(spark, sf_dir):
    """The share of the nations wanted in a segment that some rich customer settles; null for the segment that wants none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", "c_acctbal", F.col("c_nationkey").alias("field"))
    none = tables.literal(spark, [("BUILDING", None)], "segment string, field int").withColumn("field", F.col("field").cast(c.schema["field"].dataType))
    wanted = c.where("segment <> 'BUILDING'").select("segment", F.when(F.col("c_custkey") % 3 != 0, F.col("field")).alias("field")).unionByName(none)
    return audit.settled_rate(wanted, c.where("c_acctbal > 5000"), ["segment"])


@query("""WITH s AS (SELECT c_custkey AS entity, CASE WHEN c_acctbal < 0 THEN 'INSUFFICIENT' WHEN c_acctbal < 3000 THEN 'REVIEW' WHEN c_acctbal < 9000 THEN 'OK' ELSE 'NEW' END AS status FROM customer) SELECT status, count(*) AS n FROM s GROUP BY 1""")
def health_worst_first(spark, sf_dir):
    """Kinds of customers, those that need care first."""
    b = F.col("c_acctbal")
    status = F.when(b < 0, "INSUFFICIENT").when(b < 3000, "REVIEW").when(b < 9000, "OK").otherwise("NEW")
    n = table(spark, sf_dir, "customer").select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    return quality.worst_first(n, "n")


def _after_fit() -> str:
    """The dimension scores once more, over the changed side."""
    again = _FIT[_FIT.index("mine AS"):_FIT.index(",\nw AS")]
    for name in ("mine", "sc", "dm"):
        again = again.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)")
    return again.replace("FROM aligned a", "FROM changed a")


_BOTH_FITS = (_FIT + ", " + _AFTER[_AFTER.index("changed AS"):] + ", " + _after_fit()).replace("(hn - lo) / nullif(hi - lo, 0)", "(hn - lo) / nullif(rg.hi - lo, 0)")


@query(f"""WITH {_BOTH_FITS} SELECT b.home, b.competitor, b.grp AS dimension, CAST(CASE b.grp WHEN 'value' THEN 35 WHEN 'terms' THEN 25 WHEN 'record' THEN 20 WHEN 'body' THEN 12 ELSE 0 END AS DOUBLE) AS weight, b.h AS h_before, b.c AS c_before, a.h AS h_after, a.c AS c_after
FROM dm b JOIN dm2 a ON a.home = b.home AND a.competitor = b.competitor AND a.grp = b.grp WHERE a.h <> b.h OR a.c <> b.c""")
def fit_diff(spark, sf_dir):
    """Dimensions whose scores a scenario moves, by the ranges of the known facts."""
    known, pairs, spec = m.long_facts(spark, sf_dir), m.pairs(spark, sf_dir), m.spec(spark)
    none, others = F.lit(None).cast("double"), pairs.select(F.col("competitor").alias("entity")).distinct()
    overrides = others.select("entity", F.lit("unit_price").alias("field"), F.lit(-10.0).alias("pct"), none.alias("value")).unionByName(
        others.where(F.col("entity") % 3 == 0).select("entity", F.lit("size").alias("field"), none.alias("pct"), F.lit(25.0).alias("value")))
    dims, held = spec.select("field", F.col("grp").alias("dimension")), score.ranges(known)
    profile = tables.literal(spark, score.weights(["value", "terms", "record", "body"], ["value", "terms", "record", "body"]), "dimension string, weight double")
    at = lambda facts: score.dimension_scores(score.field_scores(compare.align(facts, pairs, spec), held).drop("grp"), dims, ["home", "competitor"])
    return score.fit_changes(at(known), at(compare.overlay(known, overrides)), profile, ["home", "competitor"])
