"""Queries that link: values to anchors, typed names to known ones, items of one list to another's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.matching import match_lists
from ..operators import evaluate, near, spelling
from ..operators.tables import literal
from .registry import query, table

#: field, anchors, values, reach, least and greatest plausible value.
_SPEED = [("seconds", r"0 a 100(?: km/h)?", r"([0-9]+(?:,[0-9]+)?) s\b", 200, 2.0, 6.5)]


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 6 AS k, ((20 + p_size) // 10) || ',' || ((20 + p_size) % 10) AS v, (20 + p_size) / 10 AS num FROM part)
SELECT p_partkey, v AS value, CAST(num AS DOUBLE) AS num, '0 a 100 km/h' AS anchor, CASE k WHEN 0 THEN 'before' WHEN 3 THEN 'before' ELSE 'behind' END AS side, CASE k WHEN 1 THEN 1 ELSE 0 END AS part,
CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 12 WHEN 3 THEN p_size * 5 + 1 ELSE 2 END AS BIGINT) AS distance, CAST(CASE k WHEN 0 THEN 24 WHEN 1 THEN 11 WHEN 3 THEN 13 + p_size * 5 ELSE 30 END AS BIGINT) AS start
FROM p WHERE k IN (0, 1, 3, 5) AND num <= 6.5 AND (k <> 3 OR p_size * 5 + 1 <= 200)""")
def values_by_anchor(spark, sf_dir):
    """Times with the nearest mention of what they time, before or behind, over lines but not over a blank one; too
    far ones and implausible ones stay out."""
    size = F.col("p_size")
    v = F.concat(F.floor((size + 20) / 10).cast("string"), F.lit(","), ((size + 20) % 10).cast("string"))
    forms = [
        ("Declara 0 a 100 km/h em ", v, " s."), ("Nota.\n \n\nCumpriu em ", v, " s\na marca de 0 a 100 km/h."), ("0 a 100 km/h\n \nem ", v, " s"),
        (F.concat(F.lit("0 a 100 km/h"), F.repeat(F.lit("x"), size * 5), F.lit(" ")), v, " s"), ("de 0 a 100 km/h: 1", v, " s"), ("0 a 100 km/h na pista. Depois ", v, " s: 0 a 100 km/h"),
    ]
    texts = F.array(*[F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in form]) for form in forms])
    docs = table(spark, sf_dir, "part").select("p_partkey", F.get(texts, F.pmod("p_partkey", F.lit(6)).cast("int")).alias("text"))
    return near.values_by_anchor(docs, _SPEED, id_col="p_partkey").select("p_partkey", "value", "num", "anchor", "side", "part", "distance", "start")


_LICENCE = [("version", r"[Ll]icensed under", r"(?:[Vv]ersion |NC )([0-9](?:\.[0-9])?)", 40, 1.0, 9.0)]


@query(r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '[Ll]icensed under([^\n]{0,40}?)(?:[Vv]ersion |NC )([0-9](?:\.[0-9])?)', 1) AS gap, regexp_extract_all(text, '[Ll]icensed under([^\n]{0,40}?)(?:[Vv]ersion |NC )([0-9](?:\.[0-9])?)', 2) AS v FROM documents)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n, list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))) AS total, CAST(list_sum(list_transform(gap, lambda x: length(x))) AS BIGINT) AS distance FROM h WHERE len(v) > 0""")
def licence_versions(spark, sf_dir):
    """Versions of the licences that documents name, each by its nearest mention of a licence."""
    found = near.values_by_anchor(table(spark, sf_dir, "documents"), _LICENCE)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("num").alias("total"), F.sum("distance").alias("distance"))


@query(r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[Ll]icensed under[^\n]{0,40}?(?:[Vv]ersion |NC )([0-9](?:\.[0-9])?)', 1)) AS v FROM documents)
SELECT doc_id, CAST(v AS DOUBLE) AS num, count(*) AS n_found FROM h GROUP BY ALL""")
def nearest_licences(spark, sf_dir):
    """Each version that a document names, once, with how often."""
    found = near.nearest_by_value(near.values_by_anchor(table(spark, sf_dir, "documents"), _LICENCE))
    return found.select("doc_id", "num", "n_found")


@query()
def near_suggestions(spark, sf_dir):
    """The best names for what was typed, misspelt too; names of the year typed come first."""
    typed = literal(spark, [("smal rings",), ("wigdet old 1992",), ("anvl",), ("bleu bolt 1991",), ("encabulator",)], "typed string")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (1990 + F.pmod("p_size", F.lit(4))).cast("int").alias("year")).distinct()
    return spelling.suggest_near(typed, "typed", names, "name", 6, "year")


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 4 <> 2 OR length(split_part(p_name, ' ', 1)) >= 4) AS "right", count(*) FILTER (p_partkey % 4 = 0) AS negative FROM part GROUP BY 1""")
def resolver_accuracy(spark, sf_dir):
    """What the resolver makes of every part's name, as written, turned round, misspelt, or of a name that isn't there:
    right where it finds that very name, or refuses with a suggestion."""
    k, first, last = F.pmod("p_partkey", F.lit(4)), F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    typed = F.when(k == 0, F.concat_ws(" ", F.lit("turbo"), last)).when(k == 1, F.concat_ws(" ", last, first)).when(k == 2, F.concat_ws(" ", F.left(first, F.length(first) - 1), last)).otherwise(F.initcap("p_name"))
    cases = table(spark, sf_dir, "part").select("p_brand", "p_name", (k != 0).alias("exists"), typed.alias("query"))
    names = cases.select(F.col("p_name").alias("name"))
    found = spelling.resolve(cases, names, "query", "name")
    offered = spelling.suggest_near(cases.where(~F.col("exists")), "query", names, "name", 1).select("query", F.lit(True).alias("offered"))
    j = cases.join(found, "query").join(offered, "query", "left")
    hit = F.coalesce((F.col("outcome") == "found") & (F.col("name") == F.col("p_name")), F.lit(False))
    decided = F.when(F.col("exists"), hit).otherwise(F.col("outcome") == "found")
    return evaluate.resolver_accuracy(j.select("p_brand", "exists", decided.alias("decided"), F.coalesce("offered", F.lit(False)).alias("suggested")), ["p_brand"])


@query()
def list_matching(spark, sf_dir):
    """The parts of every order against the list as another would write it: longer, turned round, in capitals, without
    some. Items are matched one to one by likeness."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, name = F.col("l_linenumber") % 4, F.col("p_name")
    other = F.when(k == 0, F.concat(F.lit("very "), name)).when(k == 1, F.concat_ws(" ", F.substring_index(name, " ", -1), F.substring_index(name, " ", 1))).when(k == 2, F.upper(name))
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("a"), other.alias("b")))).alias("x"))
    m = match_lists(F.col("x.a"), F.array_compact(F.col("x.b")), F.lit(72.0))
    return lists.withColumn("m", m).select("l_orderkey", "m.equal", F.size("m.pairs").alias("pairs"), F.array_join("m.missing", ",").alias("missing"), F.array_join("m.extra", ",").alias("extra"))
