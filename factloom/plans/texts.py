"""Queries over texts and pages: cleaning, extraction, grounding, URLs, evaluation, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import extract, ground, quality, spelling, tables
from . import mapping as m
from .decisions import _ospec
from .registry import query, table

_SQUEEZE = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[“”„«»]', '\"', 'g'), '[‐‑‒–—]', '-', 'g'), '[ \\t\\n\\x0B\\f\\r\\x{{A0}}]+', ' ', 'g'))"
_FOLD = f"translate({_SQUEEZE}, '{text.MARKED}', '{text.PLAIN}')"


@query(f"""WITH s AS (SELECT doc_id, {_FOLD.format("text")} AS f FROM documents), g AS (SELECT doc_id, f, regexp_replace(regexp_replace(f, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM s)
SELECT doc_id, sha256(f) AS folded, sha256(CASE WHEN s = '' THEN 'x' ELSE s END) AS slug, CAST(len(list_filter(string_split_regex(f, '[^a-z0-9]+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM g""")
def text_fold_slug(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("f"))
    return d.select("doc_id", F.sha2("f", 256).alias("folded"), F.sha2(text.slug_of(F.col("f")), 256).alias("slug"), F.size(text.tokens_of(F.col("f"), [])).cast("bigint").alias("n_words"))


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in extract.LINE_RULES) + " END"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(f"WITH {_LINES}, j AS (SELECT *, {_RULE} AS rule FROM l) SELECT doc_id, CAST(count(rule) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (rule IS NULL), '')) AS text_sha256 FROM j GROUP BY doc_id")
def doc_clean_lines(spark, sf_dir):
    return extract.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


@query(f"WITH {_LINES}, j AS (SELECT *, {_RULE} AS rule FROM l) SELECT rule, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM j WHERE rule IS NOT NULL GROUP BY 1")
def removed_by_rule(spark, sf_dir):
    return extract.judged_lines(table(spark, sf_dir, "documents")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {_LINES}, b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT doc_id, CAST(before // 1000 AS BIGINT) AS chunk, count(*) AS n_lines, CAST(sum(length(line) + 1) AS BIGINT) AS n_chars FROM b GROUP BY ALL")
def chunk_documents(spark, sf_dir):
    return extract.chunks(table(spark, sf_dir, "documents"), 1000)


@query(f"WITH {_LINES} SELECT sha256(line) AS line_sha256, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def repeated_lines(spark, sf_dir):
    l = extract.lines(table(spark, sf_dir, "documents")).where(F.length("line") >= 20)  # noqa: E741
    # Two levels: a line's rows of a document meet first, so a common line is spread by document.
    one = l.groupBy(F.sha2("line", 256).alias("line_sha256"), "doc_id").agg(F.count("*").alias("n"))
    return one.groupBy("line_sha256").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).where("n_docs > 1")


@query(f"""WITH s AS (SELECT doc_id, sha256({_SQUEEZE.format("text")}) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS digest, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(text.squeeze(F.col("text")), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_FOUND = _LINES + ", f AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, line, '{n}' AS rule, unnest(regexp_extract_all(line, '{p}', {g})) AS value, generate_subscripts(regexp_extract_all(line, '{p}', {g}), 1) - 1 AS nth FROM l" for n, p, g in [(n, p.replace("'", "''"), g) for n, p, g in extract.FACT_RULES]) + ")"


@query(f"WITH {_FOUND} SELECT doc_id, CAST(pos AS BIGINT) AS pos, rule, CAST(nth AS BIGINT) AS nth, value, sha256(line) AS quote FROM f")
def rule_extraction(spark, sf_dir):
    """Every fact with the whole line that it stands in."""
    f = extract.facts(table(spark, sf_dir, "documents"), places=False)
    return f.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "rule", F.col("nth").cast("bigint").alias("nth"), "value", F.sha2("line", 256).alias("quote"))


# A mark before each match parts the line into what is before the first match, then pieces that open with a match.
_PLACED = _LINES + ", m AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, line, '{n}' AS rule, unnest(regexp_extract_all(line, '{p}', {g})) AS value, unnest(regexp_extract_all(line, '{p}', 0)) AS whole, generate_subscripts(regexp_extract_all(line, '{p}', {g}), 1) - 1 AS nth, string_split(regexp_replace(line, '{p}', chr(57344) || '\\0', 'g'), chr(57344)) AS parts FROM l" for n, p, g in [(n, p.replace("'", "''"), g) for n, p, g in extract.FACT_RULES]) + """),
f AS (SELECT doc_id, pos, line, rule, nth, value, CAST(list_sum(list_transform(parts[1:nth + 1], lambda x: length(x))) AS BIGINT) + instr(whole, value) AS place FROM m)"""
_INK, _GAP = r"[^ \t\x0B\f\r]", r"[ \t\x0B\f\r]"


@query(f"""WITH {_PLACED}, b AS (SELECT *, regexp_extract(substr(line, 1, place - 1), '(?:{_INK}+{_GAP}+){{0,12}}{_INK}*$', 0) AS left_side, regexp_replace(line, '^{_GAP}+|{_GAP}+$', '', 'g') AS bare FROM f),
c AS (SELECT *, regexp_extract(left_side || substr(line, place), '^{_INK}*(?:{_GAP}+{_INK}+){{0,24}}', 0) AS cut FROM b)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, rule, CAST(nth AS BIGINT) AS nth, value, place AS at, sha256(CASE WHEN len(regexp_extract_all(line, '{_INK}+')) <= 25 THEN bare ELSE cut END) AS quote FROM c""")
def fact_quotes(spark, sf_dir):
    """Every fact with its place and the words round it."""
    return extract.facts(table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "rule", F.col("nth").cast("bigint").alias("nth"), "value", F.col("at").cast("bigint").alias("at"), F.sha2("quote", 256).alias("quote"))


_BEFORE = "regexp_replace(lower(substr(line, greatest(1, place - 80), least(80, place - 1))), '(?s)^.*[.!?\n]', '')"


@query(f"""WITH {_PLACED}, x AS (SELECT rule, {_BEFORE} AS before FROM f)
SELECT rule, count(*) AS n, count(*) FILTER (NOT regexp_matches(before, '{text.NEGATION}')) AS n_affirmed FROM x GROUP BY 1""")
def negation_at_place(spark, sf_dir):
    """Facts by rule, and how many no negation governs at their place."""
    f = extract.facts(table(spark, sf_dir, "documents"))
    return f.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(~text.negated(F.col("line"), F.col("at"))).alias("n_affirmed"))


@query(f"""WITH {_PLACED} SELECT doc_id, CAST(pos AS BIGINT) AS pos, rule, CAST(nth AS BIGINT) AS nth, value FROM f WHERE NOT regexp_matches({_BEFORE}, '{text.NEGATION}')""")
def negation_guard(spark, sf_dir):
    """The facts that no negation governs."""
    f = extract.without_negated(extract.facts(table(spark, sf_dir, "documents")))
    return f.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "rule", F.col("nth").cast("bigint").alias("nth"), "value")


@query("""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9.,/]*'), lambda x: regexp_replace(x, '[.,/]+$', ''))) AS d FROM documents),
b AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9.,/]*'), lambda x: regexp_replace(x, '[.,/]+$', ''))) AS d FROM benchmark)
SELECT doc_id, CAST(len(coalesce(n.d, [])) AS BIGINT) AS n_numbers, CAST(len(list_filter(coalesce(n.d, []), lambda x: NOT list_contains(coalesce(b.d, []), x))) AS BIGINT) AS n_unsupported FROM n LEFT JOIN b ON item_id = doc_id""")
def number_provenance(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("proof"))
    j = d.join(b, "doc_id", "left")
    own = F.array_distinct(numbers.whole_tokens(F.coalesce("text", F.lit(""))))
    lack = ground.unsupported_numbers(F.coalesce("text", F.lit("")), F.array(F.coalesce("proof", F.lit(""))))
    return j.select("doc_id", F.size(own).cast("bigint").alias("n_numbers"), F.size(lack).cast("bigint").alias("n_unsupported"))


@query(f"""WITH q AS (SELECT item_id, {_SQUEEZE.format("text")} AS qs, {_FOLD.format("text")} AS qf FROM benchmark), d AS (SELECT doc_id, {_SQUEEZE.format("text")} AS ts, {_FOLD.format("text")} AS tf FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(ts, qs) THEN 'exact' ELSE 'folded' END AS mode, CAST(CASE WHEN contains(ts, qs) THEN instr(ts, qs) ELSE instr(tf, qf) END AS BIGINT) AS at FROM q JOIN d ON contains(tf, qf)""")
def grounding_exact_folded(spark, sf_dir):
    found = ground.locate_everywhere(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return found.select("item_id", "doc_id", "mode", F.col("at").cast("bigint").alias("at"))


@query()
def grounding_fuzzy(spark, sf_dir):
    """Each benchmark item against the document of its number, as a claim against the source it cites."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("source_text"))
    return ground.locate(b.join(d, "item_id", "left")).select("item_id", "mode", "score")


@query()
def fuzzy_resolve(spark, sf_dir):
    q = tables.literal(spark, [("small rings",), ("rde widget",), ("blue bolt",), ("ring",), ("turbo encabulator",)], "query string")
    return spelling.resolve(q, table(spark, sf_dir, "part"), "query", "p_name")


@query()
def html_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("t", extract.html_text(F.col("html")))
    return p.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"), extract.is_table_text(F.col("t")).alias("in_columns"))


_URL = """u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', ''), '^www\\.', '') AS bare FROM pages),
k AS (SELECT *, regexp_replace(split_part(bare, '?', 1), '/+$', '') AS path, array_to_string(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|gclid|fbclid)')), '&') AS q FROM u)"""


@query(f"WITH {_URL} SELECT page_id, lower(CASE WHEN q = '' THEN path ELSE path || '?' || q END) AS url_key, host, CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE string_split(host, '.')[len(string_split(host, '.')) - 1] END AS registrable FROM k")
def url_keys(spark, sf_dir):
    h = text.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"), h.alias("host"), text.registrable(h).alias("registrable"))


_CLASS = "CASE WHEN host = '' THEN 'rejected' WHEN starts_with(host, 'spam') THEN 'rejected' WHEN host LIKE '%.org' THEN 'official' WHEN starts_with(host, 'blog.') THEN 'press' ELSE 'other' END"


def _classified(spark, sf_dir):
    h = text.host(F.col("url"))
    kind = F.when(h == "", "rejected").when(h.startswith("spam"), "rejected").when(h.endswith(".org"), "official").when(h.startswith("blog."), "press").otherwise("other")
    c = table(spark, sf_dir, "pages").select("page_id", "url", kind.alias("class"))
    tier = F.when(F.col("class") == "official", 1).when(F.col("class") == "press", 3).when(F.col("class") == "other", 4)
    return c.withColumn("tier", tier.cast("bigint")).withColumn("accepted", F.col("class") != "rejected")


def _best_first():
    return F.desc("accepted"), F.coalesce("tier", F.lit(4)), "url", "page_id"


@query(f"WITH {_URL}, c AS (SELECT page_id, host, url, {_CLASS} AS class FROM k) SELECT page_id, class, CAST(CASE class WHEN 'official' THEN 1 WHEN 'press' THEN 3 WHEN 'other' THEN 4 END AS BIGINT) AS tier, class <> 'rejected' AS accepted, place FROM (SELECT *, row_number() OVER (ORDER BY class = 'rejected', CASE class WHEN 'official' THEN 1 WHEN 'press' THEN 3 ELSE 4 END, url, page_id) AS place FROM c) WHERE place <= 100")
def url_class_top_100(spark, sf_dir):
    """A report of the hundred best sources: accepted ones first, then by tier and address."""
    from pyspark.sql import Window as W

    best = _classified(spark, sf_dir).orderBy(*_best_first()).limit(100)
    return best.withColumn("place", F.row_number().over(W.orderBy(*_best_first())).cast("bigint")).select("page_id", "class", "tier", "accepted", "place")


@query(f"WITH {_URL}, c AS (SELECT page_id, host, url, {_CLASS} AS class FROM k) SELECT page_id, url, class, CAST(CASE class WHEN 'official' THEN 1 WHEN 'press' THEN 3 WHEN 'other' THEN 4 END AS BIGINT) AS tier, class <> 'rejected' AS accepted FROM c ORDER BY class = 'rejected', CASE class WHEN 'official' THEN 1 WHEN 'press' THEN 3 ELSE 4 END, url, page_id")
def url_classes(spark, sf_dir):
    """Every page with its class, the best first by a range sort; url_class_top_100 is the head of it."""
    return _classified(spark, sf_dir).orderBy(*_best_first())


_DOMAINS = [("example.com", "approved"), ("blog.example.com", "rejected"), ("example.org", "approved"), ("example", "rejected"), ("net", "rejected")]


@query(f"""WITH {_URL}, d(suffix, rule) AS (VALUES ('example.com', 'approved'), ('blog.example.com', 'rejected'), ('example.org', 'approved'), ('example', 'rejected'), ('net', 'rejected')),
j AS (SELECT page_id, host, arg_max(rule, length(suffix)) AS rule, max(length(suffix)) AS n FROM k LEFT JOIN d ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY ALL) SELECT page_id, coalesce(rule, 'unknown') AS rule FROM j""")
def domain_suffix_rule(spark, sf_dir):
    d = tables.literal(spark, _DOMAINS, "suffix string, rule string")
    p = table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))
    # A host has few suffixes: they meet the rules by equality instead of every host meeting every rule.
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hit = p.select("page_id", F.explode(suffixes).alias("suffix")).join(d, "suffix", "left")
    return hit.groupBy("page_id").agg(F.coalesce(F.max_by("rule", F.when(F.col("rule").isNotNull(), F.length("suffix"))), F.lit("unknown")).alias("rule"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, regexp_extract(props, '"k"\\s*:\\s*("[^"]*"|[^,}\\]]+)') AS pair, json_valid(props) AS valid FROM events""")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), text.json_pair(F.col("props"), "k").alias("pair"), F.try_parse_json("props").isNotNull().alias("valid"))


_PRED = "p AS (SELECT l.doc_id, lang, quality, CASE WHEN len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) >= 40 AND NOT regexp_matches(text, '[#*%]{3}') THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id))"


def _predictions(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= 40) & ~F.col("text").rlike("[#*%]{3}")
    return lab.join(d, "doc_id").select("doc_id", "lang", "quality", F.when(good, 1).otherwise(0).alias("pred"))


_SUMS = "count(*) AS n, count(*) FILTER (quality = pred) AS agree, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 0 AND pred = 1) AS fp, count(*) FILTER (quality = 1 AND pred = 0) AS fn"


@query(f"WITH {_PRED}, s AS (SELECT lang, {_SUMS} FROM p GROUP BY 1) SELECT *, round(agree / CAST(n AS DOUBLE), 4) AS accuracy, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall FROM s")
def eval_metrics(spark, sf_dir):
    return quality.confusion(_predictions(spark, sf_dir), "quality", "pred", "lang")


@query(f"WITH {_PRED}, s AS (SELECT {_SUMS} FROM p), v AS (SELECT unnest(['accuracy', 'recall', 'toxic_recall']) AS metric, unnest([round(agree / CAST(n AS DOUBLE), 4), round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4), NULL]) AS value, unnest([n, tp + fn, 0]) AS n FROM s) SELECT metric, value, CAST(n AS BIGINT) AS n, CAST(least AS DOUBLE) AS least, inviolable, CASE WHEN n > 0 AND value IS NOT NULL THEN value >= least END AS passed FROM v JOIN (VALUES ('accuracy', 0.9, true), ('recall', 0.5, false), ('toxic_recall', 0.5, true)) t(metric, least, inviolable) USING (metric)")
def eval_gates(spark, sf_dir):
    s = quality.confusion(_predictions(spark, sf_dir), "quality", "pred")
    row = lambda name, value, n: F.struct(F.lit(name).alias("metric"), value.alias("value"), n.cast("bigint").alias("n"))
    v = s.select(F.inline(F.array(row("accuracy", F.col("accuracy"), F.col("n")), row("recall", F.col("recall"), F.col("tp") + F.col("fn")), row("toxic_recall", F.lit(None).cast("double"), F.lit(0)))))
    return quality.gates(v, tables.literal(spark, [("accuracy", 0.9, True), ("recall", 0.5, False), ("toxic_recall", 0.5, True)], "metric string, least double, inviolable boolean"))


@query("SELECT CAST(sum(quality) AS BIGINT) AS part, count(*) AS whole, round(sum(quality) / nullif(CAST(count(*) AS DOUBLE), 0), 4) AS ratio FROM labels")
def ratio_of_sums(spark, sf_dir):
    return quality.pooled(table(spark, sf_dir, "labels").withColumn("one", F.lit(1)), "quality", "one")


@query(f"""WITH {m.OBS}, {"ospec(field, tol_abs, tol_rel) AS (VALUES ('unit_price', NULL::DOUBLE, 0.25), ('discount', 0.05, NULL), ('tax', 0.04, NULL))"},
t AS (SELECT entity, field, tier, min(num) AS low, max(num) AS high, max(ts) AS ts FROM obs GROUP BY ALL), b AS (SELECT *, min(tier) OVER (PARTITION BY entity, field) AS best, max(ts) OVER (PARTITION BY entity, field) AS last FROM t),
d AS (SELECT entity, field, best, last, (high - low = 0) OR coalesce(high - low <= tol_abs + 1e-9, false) OR coalesce(high - low <= tol_rel * greatest(abs(low), abs(high)), false) AS agree FROM b JOIN ospec USING (field) WHERE tier = best),
a AS (SELECT *, CAST(greatest(0, epoch(TIMESTAMP '2001-11-01' - last) // 86400) AS BIGINT) AS age FROM d),
g AS (SELECT entity, count(*) AS n_fields, count(*) FILTER (agree) AS verified, count(*) FILTER (age > 30) AS stale, count(*) FILTER (agree AND best >= 3) AS unconfirmed, count(*) FILTER (NOT agree) AS conflicts FROM a GROUP BY 1)
SELECT entity, n_fields, verified, stale, unconfirmed, conflicts, round(verified / CAST(n_fields AS DOUBLE), 4) AS verified_share,
CASE WHEN verified < 0.5 * n_fields THEN 'INSUFFICIENT' WHEN conflicts > 0 OR stale > 0 OR entity % 50 = 0 OR unconfirmed > 0 THEN 'REVIEW' ELSE 'OK' END AS status,
CASE WHEN verified < 0.5 * n_fields THEN 'few_verified' WHEN conflicts > 0 THEN 'has_conflict' WHEN stale > 0 THEN 'has_stale' WHEN entity % 50 = 0 THEN 'has_blocked_source' WHEN unconfirmed > 0 THEN 'has_unconfirmed' ELSE 'nothing_open' END AS rule FROM g""")
def knowledge_health(spark, sf_dir):
    from ..operators.decide import decide

    obs = m.observations(spark, sf_dir)
    last = obs.groupBy("entity", "field").agg(F.max("ts").alias("last"))
    f = decide(obs, _ospec(spark)).select("entity", "field", "status", F.col("best_tier").alias("tier")).join(last, ["entity", "field"])
    f = f.withColumn("age_days", numbers.age_days(F.col("last"), F.lit("2001-11-01").cast("timestamp")))
    return quality.health(f, "entity", F.col("entity") % 50 == 0)


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'indeterminate' WHEN c_acctbal >= 1000 THEN 'true' ELSE 'false' END AS flag, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'FURNITURE' THEN 5 WHEN c_mktsegment = 'MACHINERY' THEN 10 END AS DOUBLE) AS score FROM customer")
def three_valued_flag(spark, sf_dir):
    from ..operators.score import ordinal

    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b.isNull(), "indeterminate").when(b >= 1000, "true").otherwise("false").alias("flag"), ordinal(F.col("c_mktsegment"), ["BUILDING", "FURNITURE", "MACHINERY"]).alias("score"))
