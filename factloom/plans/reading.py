"""Queries of labelled values, typed normalisation, names, overrides and evaluation.

The sheets are texts made of the rows of `part`, so the SQL says what must be read from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import compare, decide, evaluate, labels, score, tables
from ..operators.tables import literal
from . import mapping as m
from .decisions import _DECIDED, _ospec
from .registry import query, table

_LABELS = [("power", "power", "number", "power"), ("max. torque", "torque", "number", "torque"), ("price", "price", "price", None), ("colours", "colours", "list", None), ("sunroof", "sunroof", "flag", None)]
_KNOWN = [r[0] for r in _LABELS]


def _s(x: Column) -> Column:
    return x.cast("string")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text): a sheet of each part; by its key label and value stand on two lines, in columns or behind a colon."""
    p = tables.dealt(table(spark, sf_dir, "part"))
    size, price = F.col("p_size"), F.bround("p_retailprice", 0).cast("long")
    pairs = [
        ("Power", F.concat(_s(size), F.lit(" kW"))), ("Max. Torque (net)", F.concat(_s(size), F.lit(" lb.ft"))), ("Price", F.concat(F.lit("R$ "), text.thousands(price))),
        ("Colours", F.when(size % 5 == 0, F.lit("n/d")).otherwise(F.regexp_replace("p_name", " ", " e "))), ("Sunroof", F.when(size % 2 == 0, F.lit("Sim")).otherwise(F.lit("Não"))),
    ]
    form = F.pmod("p_partkey", F.lit(3))
    line = lambda k, v: F.when(form == 0, F.concat(F.lit(f"{k}\n\n"), v)).when(form == 1, F.concat(F.lit(f"  {k}\t"), v)).otherwise(F.concat(F.lit(f"{k}: "), v))
    return p.select("p_partkey", F.concat_ws("\n", F.col("p_name"), *[line(k, v) for k, v in pairs], F.lit("Sunroof")).alias("text"))


_FACTS = """
f AS (
  SELECT p_partkey, unnest([
    struct_pack(field := 'power', num := CAST(round_even(p_size * 1.3596, 0) AS DOUBLE), flag := NULL::BOOLEAN, items := NULL::VARCHAR, status := 'read'),
    struct_pack(field := 'torque', num := CAST(round_even(p_size * 1.3558, 0) AS DOUBLE), flag := NULL, items := NULL, status := 'read'),
    struct_pack(field := 'price', num := CAST(round_even(p_retailprice, 0) AS DOUBLE), flag := NULL, items := NULL, status := 'read'),
    struct_pack(field := 'colours', num := NULL, flag := NULL, items := CASE WHEN p_size % 5 <> 0 THEN array_to_string(list_distinct(list_sort(string_split(lower(p_name), ' '))), ',') END, status := CASE WHEN p_size % 5 = 0 THEN 'declared_absent' ELSE 'read' END),
    struct_pack(field := 'sunroof', num := NULL, flag := p_size % 2 = 0, items := NULL, status := 'read')], recursive := true)
  FROM part)"""


@query(f"WITH {_FACTS}, g AS (SELECT p_partkey, field, num, flag, items, status FROM f) SELECT p_partkey, field, num, flag, CASE WHEN items IS NOT NULL THEN (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(string_split(items, ',')) AS x)) END AS items, status FROM g")
def label_facts(spark, sf_dir):
    """Values of known labels in sheets, in all three forms, typed by their fields."""
    d = sheets(spark, sf_dir)
    pairs = labels.next_line_pairs(d, _KNOWN, id_col="p_partkey").unionByName(labels.column_pairs(d, _KNOWN, id_col="p_partkey")).unionByName(labels.colon_pairs(d, _KNOWN, id_col="p_partkey"))
    f = labels.pair_facts(pairs, labels.label_map(spark, _LABELS))
    return f.select("p_partkey", "field", "num", "flag", F.array_join(F.array_sort("items"), ",").alias("items"), "status")


@query("SELECT p_partkey % 3 AS form, count(*) AS n, CAST(sum(CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 1 END) AS BIGINT) AS total FROM part GROUP BY 1")
def label_pairs_by_form(spark, sf_dir):
    """Sheets of each form, and the lines by which the value of 'Price' lies below the sheet's head."""
    d = sheets(spark, sf_dir)
    parts = [labels.next_line_pairs(d, ["price"], id_col="p_partkey"), labels.column_pairs(d, ["price"], id_col="p_partkey"), labels.colon_pairs(d, ["price"], id_col="p_partkey")]
    each = [x.select(F.pmod("p_partkey", F.lit(3)).cast("bigint").alias("form"), F.when(F.lit(i == 0), F.floor(F.col("pos") / 3) + 1).otherwise(F.col("pos") - 2).cast("bigint").alias("at")) for i, x in enumerate(parts)]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("form").agg(F.count("*").alias("n"), F.sum("at").alias("total"))


_PRESENCE = [("apache", r"(?i)apache license"), ("mit", r"(?i)mit license"), ("rights", r"(?i)all rights reserved"), ("copyright", r"(?i)(copyright|©)"), ("licence", r"(?i)licen[cs]e")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _PRESENCE) + " END AS terms FROM documents WHERE text IS NOT NULL AND (" + " OR ".join(f"regexp_matches(text, '{p}')" for _, p in _PRESENCE) + ")")
def presence_rules(spark, sf_dir):
    """Which terms a document names: the first alternative, most specific first."""
    return table(spark, sf_dir, "documents").select("doc_id", labels.first_alternative(F.col("text"), _PRESENCE).alias("terms")).where("terms is not null")


_NEAR = (r"(?i)(?:the|de|la|der)", r"[0-9]+", 80)


@query(rf"SELECT doc_id, CAST(len(v) AS BIGINT) AS n, sha256(array_to_string(v, ',')) AS found FROM (SELECT doc_id, regexp_extract_all(text, '(?:{_NEAR[0]})[^\n]{{0,{_NEAR[2]}}}?({_NEAR[1]})', 1) AS v FROM documents WHERE text IS NOT NULL) WHERE len(v) > 0")
def value_near_anchor(spark, sf_dir):
    """The nearest number behind each anchor word of a line."""
    v = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", labels.values_near(F.col("text"), *_NEAR).alias("v"))
    return v.where(F.size("v") > 0).select("doc_id", F.size("v").cast("bigint").alias("n"), F.sha2(F.array_join("v", ","), 256).alias("found"))


@query("""SELECT p_partkey, CAST(p_size * 100 + 1000 AS DOUBLE) AS rpm, CAST(200 + p_size AS BIGINT) AS tyre_width, CAST(60 + p_size % 30 AS BIGINT) AS tyre_profile, CAST(15 + p_size % 8 AS BIGINT) AS tyre_rim, CAST(p_size % 12 + 1 AS DOUBLE) AS cylinders,
CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS flag, floor(p_retailprice) AS price, abs(p_size - 25) <= 2 OR abs(p_size - 25) <= 0.1 * 25 AS near_25, round(p_size * 0.55 + 10.0::DOUBLE * 0.45, 2) AS combined FROM part""")
def typed_values(spark, sf_dir):
    """Numbers, tyres, counts, flags and prices as sheets write them."""
    size = F.col("p_size")
    t = numbers.tyre(F.concat(_s(200 + size), F.lit("/"), _s(60 + size % 30), F.lit(" R"), _s(15 + size % 8)))
    flag = F.when(size % 4 == 1, F.lit("não")).when(size % 4 == 2, F.lit(" Sim ")).when(size % 4 == 3, F.lit("of series"))
    num = lambda kind, raw: labels.normalised(F.lit(kind), raw, F.lit(None).cast("string"))["num"]
    return tables.dealt(table(spark, sf_dir, "part")).select(
        "p_partkey", num("rpm", F.concat(text.thousands(size * 100 + 1000), F.lit(" a 9.000 rpm"))).alias("rpm"), *[t[k].cast("bigint").alias(f"tyre_{k}") for k in ("width", "profile", "rim")],
        numbers.cylinders(F.concat(F.lit("V"), _s(size % 12 + 1))).alias("cylinders"), numbers.parse_flag(flag).alias("flag"), num("price", F.concat(text.thousands(F.floor("p_retailprice")), F.lit(" reais"))).alias("price"),
        numbers.close(F.lit(25.0), size.cast("double"), F.lit(2.0), F.lit(0.1)).alias("near_25"), numbers.combined_consumption(size.cast("double"), F.lit(10.0)).alias("combined"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'no_number' WHEN 2 THEN 'unknown_unit' ELSE 'unknown_kind' END AS reason, 'unread' AS status FROM part""")
def unread_values(spark, sf_dir):
    """What cannot be read says why."""
    k = F.pmod("p_partkey", F.lit(4))
    raw = F.when(k == 0, F.lit("  ")).when(k == 1, F.col("p_name")).when(k == 2, F.concat(_s(F.col("p_size")), F.lit(" parsec"))).otherwise(F.lit("5"))
    kind = F.when(k == 3, F.lit("colour")).otherwise(F.lit("number"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.normalised(kind, raw, F.lit("power")).alias("n")).select("p_partkey", "n.reason", "n.status")


@query("""SELECT p_partkey, p_name AS version, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS words, split_part(p_name, ' ', 2) AS short, p_name AS rest, CAST(1990 + p_size AS BIGINT) AS year, 'of ' || p_name AS label_text,
strftime(DATE '1994-03-01' + CAST(p_size AS INTEGER), '%d/%m/%Y') AS shown FROM part""")
def version_names(spark, sf_dir):
    """Names as makers write them, brought back to what tells them apart."""
    name, size = F.col("p_name"), F.col("p_size")
    bare = F.concat(F.initcap(name), F.lit(" – Automático 4WD"))
    y = numbers.split_year(F.concat(F.lit("1991 "), name, F.lit(" "), _s(1990 + size)))
    day = F.date_add(F.lit("1994-03-01").cast("date"), size.cast("int"))
    first = F.substring_index(name, " ", 1)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.version_name(bare).alias("version"), F.array_join(F.array_sort(F.filter(text.distinctive(F.concat(bare, F.lit(" LTD+ cd"))), lambda w: ~w.isin("limited", "plus"))), ",").alias("words"),
        text.canonical_version(F.upper(first), F.concat(F.initcap(first), F.lit(" "), F.substring_index(name, " ", -1))).alias("short"), F.regexp_replace(y["rest"], "^1991 ", "").alias("rest"), y["year"].cast("bigint").alias("year"),
        text.label(F.concat(F.lit("Of "), name, F.lit(" (net)"))).alias("label_text"), numbers.display_date(F.date_format(day, "yyyy-MM-dd")).alias("shown"))


_LACK = "list_filter({}, lambda x: NOT list_contains({}, x))"


@query(f"""WITH {m.SHEET}, {m.PAIRS}, j AS (SELECT home, competitor, coalesce(h.flags, []) AS e, coalesce(c.flags, []) AS g FROM pair JOIN sheet h ON h.p_partkey = home JOIN sheet c ON c.p_partkey = competitor)
SELECT home, competitor, len({_LACK.format("e", "g")}) = 0 AND len({_LACK.format("g", "e")}) = 0 AS equal, lower(array_to_string(list_sort({_LACK.format("e", "g")}), ',')) AS missing, lower(array_to_string(list_sort({_LACK.format("g", "e")}), ',')) AS extra FROM j""")
def list_comparison(spark, sf_dir):
    """Lists matched one to one: what a competitor's lacks and what it has more."""
    s = m.sheet(spark, sf_dir).select("p_partkey", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
    side = lambda name: s.select(F.col("p_partkey").alias(name), F.col("flags").alias(f"{name}_flags"))
    j = m.pairs(spark, sf_dir).join(side("home"), "home").join(side("competitor"), "competitor")
    c = j.select("home", "competitor", evaluate.compare_list(F.col("home_flags"), F.col("competitor_flags")).alias("c"))
    return c.select("home", "competitor", "c.equal", F.array_join("c.missing", ",").alias("missing"), F.array_join("c.extra", ",").alias("extra"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contained' ELSE 'different' END AS mode FROM part")
def text_comparison(spark, sf_dir):
    """Expected and read texts: the same, more specific, or another."""
    k, name = F.pmod("p_partkey", F.lit(3)), F.col("p_name")
    got = F.when(k == 0, F.concat(F.lit("  "), F.upper(name))).when(k == 1, F.concat(F.lit("Very "), name, F.lit(", on demand"))).otherwise(F.substring_index(name, " ", 1))
    return table(spark, sf_dir, "part").select("p_partkey", evaluate.compare_text(name, got).alias("mode"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(l_tax - 0.02) <= 0.001 OR abs(l_tax - 0.06) <= 0.001) AS n_any FROM lineitem GROUP BY 1")
def any_of_expected(spark, sf_dir):
    ok = evaluate.compare_any(F.array(F.lit(0.02), F.lit(0.06)), F.col("l_tax") + F.lit(0.0), F.lit(0.001), F.lit(None).cast("double"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_any"))


@query("""WITH t AS (SELECT p_partkey AS entity, unnest([struct_pack(field := 'name', value := p_name), struct_pack(field := 'kind', value := CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_type END), struct_pack(field := 'size', value := CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) END)], recursive := true) FROM part)
SELECT field, count(*) AS n, count(*) FILTER (trim(value) = '') AS n_blank FROM t WHERE value IS NOT NULL GROUP BY 1""")
def truth_targets(spark, sf_dir):
    """Expected values of nested rows as targets, and their faults."""
    fields = {"name": "p_name", "kind": "CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_type END", "size": "CASE WHEN p_size > 5 THEN p_size END"}
    t = evaluate.truth_faults(evaluate.flattened(table(spark, sf_dir, "part"), "p_partkey", fields))
    return t.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("fault") == "blank").alias("n_blank"))


@query(f"WITH {_DECIDED} SELECT field, count(*) AS expected, count(*) FILTER (NOT agree) AS shown FROM conf WHERE entity % 2 = 0 GROUP BY 1")
def divergence_recall(spark, sf_dir):
    """Of the divergences expected, those that the decisions show."""
    expected = m.observations(spark, sf_dir).where("entity % 2 = 0").select("entity", "field")
    return evaluate.divergence_recall(expected, decide.decide(m.observations(spark, sf_dir), _ospec(spark)), ["field"])


_OVERRIDES = """o AS (SELECT p_partkey AS entity, unnest([struct_pack(field := 'price', pct := CAST(p_size AS DOUBLE) * 2 - 40, value := NULL::DOUBLE), struct_pack(field := CASE WHEN p_size % 3 = 0 THEN 'colour' ELSE 'size' END, pct := CASE WHEN p_size % 2 = 0 THEN 10.0::DOUBLE END, value := CASE WHEN p_size % 5 = 0 THEN 1.0::DOUBLE END)], recursive := true) FROM part),
w AS (SELECT *, CASE WHEN (pct IS NOT NULL) = (value IS NOT NULL) THEN 'not_one_form' WHEN field = 'colour' THEN 'unknown_field' WHEN abs(pct) > 50 THEN 'beyond_range' END AS fault FROM o)"""


def _overrides(spark, sf_dir):
    size, none = F.col("p_size"), F.lit(None).cast("double")
    one = F.struct(F.lit("price").alias("field"), (size.cast("double") * 2 - 40).alias("pct"), none.alias("value"))
    two = F.struct(F.when(size % 3 == 0, "colour").otherwise("size").alias("field"), F.when(size % 2 == 0, F.lit(10.0)).alias("pct"), F.when(size % 5 == 0, F.lit(1.0)).alias("value"))
    o = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.explode(F.array(one, two)).alias("o")).select("entity", "o.*", F.lit(False).alias("remove"))
    return compare.override_faults(o, [r[0] for r in m.SPEC_ROWS])


@query(f"WITH {_OVERRIDES} SELECT entity, field, fault FROM w")
def override_faults(spark, sf_dir):
    """Each hypothesis with what is wrong with it."""
    return _overrides(spark, sf_dir).select("entity", "field", "fault")


@query(f"WITH {_OVERRIDES}, g AS (SELECT entity, arg_max(struct_pack(field := field, pct := pct), struct_pack(a := abs(pct), b := field)) AS o FROM w WHERE fault IS NULL AND pct IS NOT NULL GROUP BY 1) SELECT entity, o.field AS field, o.pct AS pct FROM g")
def largest_override(spark, sf_dir):
    return compare.largest_override(_overrides(spark, sf_dir), ["entity"])


@query(f"""WITH {m.FACTS}, {m.SPEC}, rg AS (SELECT field, min(num) AS lo, max(num) AS hi, count(DISTINCT num) AS nv FROM fact WHERE num IS NOT NULL GROUP BY 1)
SELECT fact.field, count(*) AS n, count(*) FILTER (CASE WHEN direction = 'low' THEN 10 * (rg.hi - num) / (rg.hi - lo) ELSE 10 * (num - lo) / (rg.hi - lo) END < 1) AS n_floor FROM fact JOIN rg USING (field) JOIN spec USING (field) WHERE num IS NOT NULL AND nv >= 2 GROUP BY 1""")
def floor_warnings(spark, sf_dir):
    """Values whose score lies at the bottom of the observed range."""
    known = m.long_facts(spark, sf_dir).where("num is not null")
    j = known.join(score.ranges(known).where(~F.col("insufficient")), "field").join(m.spec(spark).select("field", "direction"), "field")
    share = (F.col("num") - F.col("low")) / (F.col("high") - F.col("low"))
    low = F.when(F.col("direction") == "low", (F.col("high") - F.col("num")) / (F.col("high") - F.col("low"))).otherwise(share)
    return j.groupBy("field").agg(F.count("*").alias("n"), F.count_if(10 * low < 1).alias("n_floor"))


_WANTED = ["red ring", "small gizmo big", "hot", "unknown thing", "blue bolt"]


@query(f"""WITH q(q) AS (VALUES {', '.join(f"('{x}')" for x in _WANTED)}), c AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT q, unnest(string_split(q, ' ')) AS w FROM q), n AS (SELECT name, unnest(string_split(name, ' ')) AS w FROM c),
h AS (SELECT q, name, count(*) AS hits FROM (SELECT DISTINCT * FROM w) JOIN (SELECT DISTINCT * FROM n) USING (w) GROUP BY ALL),
s AS (SELECT q, name, hits, hits / len(string_split(q, ' '))::DOUBLE AS coverage, 2.0 * hits / (len(string_split(q, ' ')) + len(string_split(name, ' '))) AS score FROM h)
SELECT q, name, CAST(coverage AS DOUBLE) AS coverage, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY q ORDER BY coverage DESC, score DESC, name) AS place FROM s QUALIFY place <= 5""")
def suggestions(spark, sf_dir):
    """The five best names for what was typed, by words in common: coverage, then likeness, then name."""
    q = literal(spark, [(x,) for x in _WANTED], "q string")
    return compare.suggest(q, "q", table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", 5).withColumnRenamed("p_name", "name").select("q", "name", "coverage", "score", F.col("place").cast("bigint").alias("place"))
