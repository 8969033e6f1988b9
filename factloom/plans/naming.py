"""Queries of what texts name and what cells of grids say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, naming, tables
from ..operators.tables import literal
from .registry import query, table
from .texts import _FOLD

_PLAIN = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"
_LONE = "' ' || replace({}, ' ', '  ') || ' '"  # every word with spaces of its own, so that neighbours can both be counted


@query(f"""WITH b AS (SELECT {_PLAIN.format(_FOLD.format("text"))} AS p FROM benchmark),
n AS (SELECT DISTINCT array_to_string(string_split(p, ' ')[1:k], ' ') AS name FROM b, (VALUES (3), (6)) AS r(k) WHERE p <> ''),
d AS (SELECT doc_id, {_LONE.format(_PLAIN.format(_FOLD.format("text")))} AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, name, (length(t) - length(replace(t, {_LONE.format("name")}, ''))) // (length({_LONE.format("name")})) AS c FROM d, n WHERE contains(t, {_LONE.format("name")})),
i AS (SELECT a.name, b.name AS longer, (length({_LONE.format("b.name")}) - length(replace({_LONE.format("b.name")}, {_LONE.format("a.name")}, ''))) // length({_LONE.format("a.name")}) AS c FROM n a, n b WHERE a.name <> b.name AND contains({_LONE.format("b.name")}, {_LONE.format("a.name")}))
SELECT h.doc_id, h.name, CAST(h.c - coalesce(sum(l.c * i.c), 0) AS BIGINT) AS n_found FROM h LEFT JOIN i ON i.name = h.name LEFT JOIN h l ON l.doc_id = h.doc_id AND l.name = i.longer GROUP BY h.doc_id, h.name, h.c HAVING h.c - coalesce(sum(l.c * i.c), 0) > 0""")
def names_in_documents(spark, sf_dir):
    """Openings of benchmark items, of three words and of six, in all documents; a short one inside a long one is not
    counted."""
    words = F.split(F.trim(naming.plain_words(F.col("text"))), " ")
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.array_join(F.slice(words, 1, k), " ") for k in (3, 6)])).alias("name"))
    return naming.find_names(table(spark, sf_dir, "documents"), names).groupBy("doc_id", "name").agg(F.count("*").alias("n_found"))


@query("""SELECT p_partkey, CASE WHEN k = 2 THEN 'not_understood' WHEN k = 1 AND p_name <> 'blue bolt' THEN 'must_choose' ELSE 'resolved' END AS outcome, CASE WHEN k <> 2 AND (k <> 1 OR p_name = 'blue bolt') THEN p_name END AS entity,
CAST(CASE k WHEN 2 THEN NULL WHEN 1 THEN CASE WHEN p_name = 'blue bolt' THEN 1 ELSE 2 END ELSE 1 END AS INTEGER) AS n_choices, CAST(CASE WHEN k = 3 THEN 1990 + p_size END AS INTEGER) AS year FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def identified_requests(spark, sf_dir):
    """Requests in free words, resolved to the part that they name."""
    p = table(spark, sf_dir, "part")
    k, name = F.pmod("p_partkey", F.lit(4)), F.col("p_name")
    said = F.when(k == 0, F.concat(F.lit("Please, the "), F.upper(name), F.lit("!"))).when(k == 1, F.concat(name, F.lit(" or a Blue-Bolt?"))).when(k == 2, F.lit("some other thing")).otherwise(F.concat(name, F.lit(", the "), name, F.lit(" of "), (1990 + F.col("p_size")).cast("string")))
    catalogue = p.select(name.alias("name"), name.alias("entity")).distinct()
    out = naming.identify(p.select("p_partkey", said.alias("text")), catalogue, id_col="p_partkey")
    return out.select("p_partkey", "outcome", "entity", F.size("choices").alias("n_choices"), "year")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN CASE p_partkey % 3 WHEN 0 THEN 'gm' ELSE 'land' END END AS brand, CASE WHEN p_partkey % 3 <> 2 THEN split_part(p_name, ' ', 1) END AS model,
CASE WHEN p_partkey % 3 <> 2 THEN split_part(p_name, ' ', 2) || ' XL' END AS version, CAST(CASE p_partkey % 3 WHEN 0 THEN 1990 + p_size END AS INTEGER) AS year FROM part""")
def explicit_requests(spark, sf_dir):
    """Brand, model and version of requests that say all three."""
    k, name, year = F.pmod("p_partkey", F.lit(3)), F.col("p_name"), (1990 + F.col("p_size")).cast("string")
    said = F.when(k == 0, F.concat_ws(" ", F.lit("Chevrolet"), name, F.lit("XL"), year)).when(k == 1, F.concat(F.lit("land  ROVER "), name, F.lit(" XL"))).otherwise(F.concat_ws(" ", F.lit("gm"), F.substring_index(name, " ", 1)))
    r = naming.explicit_request(said, {"gm": "gm", "chevrolet": "gm", "land": "other", "land rover": "land"})
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("""SELECT DISTINCT p_name || ' Deluxe ' || p_brand AS request, CASE WHEN split_part(p_name, ' ', 1) NOT IN ('old', 'cold') THEN 'the_' || replace(p_name, ' ', '_') END AS id, 1.0::DOUBLE AS coverage FROM part""")
def likely_ids(spark, sf_dir):
    """The id that a request most likely means, by the share of the id's words that it has; old and cold are too near."""
    p = table(spark, sf_dir, "part")
    requests = p.select(F.concat_ws(" ", "p_name", F.lit("Deluxe"), "p_brand").alias("request"))
    ids = p.select(F.concat(F.lit("the_"), F.translate("p_name", " ", "_")).alias("id")).distinct()
    return naming.likely_id(requests, ids, "request", "id", {"deluxe": "the"})


@query(r"""SELECT page_id, CASE WHEN page_id % 10 = 0 OR (url IS NOT NULL AND list_has_any(string_split_regex(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1)), '[^a-z0-9]+'), ['25', 'or', '825'])) THEN 'version' ELSE 'line' END AS scope FROM pages""")
def document_scopes(spark, sf_dir):
    """Whether a page is one version's own or the whole line's."""
    kind = F.when(F.pmod("page_id", F.lit(10)) == 0, "sheet").otherwise("page")
    return table(spark, sf_dir, "pages").select("page_id", naming.document_scope(kind, F.col("url"), F.lit("825 or 25"), ["sheet"]).alias("scope"))


_CELLS = [
    ("power", r"^(\d+) ?/ ?[\d.]+$", 1, "power", "number", "power", "cv"), ("power", r"^\d+ ?/ ?([\d.]+)$", 1, "rpm", "rpm", None, "rpm"), ("torque", r"^(\d+)$", 1, "torque", "number", "torque", "Nm"),
    ("gearbox", r"^(\D+?) \d+$", 1, "gearbox", "text", None, ""), ("gearbox", r"(\d+)$", 1, "gears", "count", None, ""), ("roof", r"^(.+)$", 1, "roof", "flag", None, ""),
]


@query("""WITH c AS (SELECT p_partkey, p_size, unnest([struct_pack(row := 1, field := 'power', raw := CAST(p_size * 10 AS VARCHAR), num := p_size * 10.0::DOUBLE, txt := NULL), struct_pack(row := 1, field := 'rpm', raw := '3.500', num := 3500.0::DOUBLE, txt := NULL),
struct_pack(row := 3, field := 'torque', raw := CAST(p_size + 100 AS VARCHAR), num := p_size + 100.0::DOUBLE, txt := NULL), struct_pack(row := 4, field := 'gearbox', raw := 'Automatic', num := NULL, txt := 'Automatic'), struct_pack(row := 4, field := 'gears', raw := CAST(p_size % 9 + 1 AS VARCHAR), num := p_size % 9 + 1.0::DOUBLE, txt := NULL),
struct_pack(row := 5, field := 'roof', raw := CASE WHEN p_size % 2 = 0 THEN 'Sim' ELSE 'Não' END, num := NULL, txt := NULL)], recursive := true) FROM part)
SELECT p_partkey, row, field, raw, num, CASE WHEN field = 'roof' THEN p_size % 2 = 0 END AS flag, txt, 'read' AS status FROM c WHERE field <> 'torque' OR p_size % 5 <> 0""")
def cells_to_facts(spark, sf_dir):
    """Facts of the cells of one version in a sheet of each part: merged cells, marks, labels carried down and with a
    footnote's digit."""
    size = F.col("p_size")
    s = lambda c: c.cast("string")
    cell = lambda row, col, value, span=1: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(span).alias("span"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    cells = [
        cell(0, 0, ""), cell(0, 1, "XL"), cell(0, 2, "XLT"), cell(0, 3, "Black"), cell(1, 0, "Power (net)"), cell(1, 1, F.concat(s(size * 10), F.lit("/3.500")), 2), cell(1, 2, ""), cell(1, 3, "9/1"), cell(2, 0, ""), cell(2, 1, "x"), cell(2, 2, " – "), cell(2, 3, ""),
        cell(3, 0, "Torque1"), cell(3, 1, "1"), cell(3, 2, F.when(size % 5 == 0, "•").otherwise(s(size + 100))), cell(4, 0, "Gearbox"), cell(4, 1, "Manual 5"), cell(4, 2, F.concat(F.lit("Automatic "), s(size % 9 + 1))), cell(5, 0, "Roof"), cell(5, 1, "Não"), cell(5, 2, F.when(size % 2 == 0, "Sim").otherwise("Não")),
    ]
    g = tables.dealt(table(spark, sf_dir, "part")).select("p_partkey", F.explode(F.array(*cells)).alias("c")).select("p_partkey", "c.*")
    return grid.cell_facts(g, "p_partkey", "XLT", _CELLS).select("p_partkey", "row", "field", "raw", "num", "flag", "txt", "status")
