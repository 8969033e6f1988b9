"""Queries of connectors: saved pages made of the tables are read by declared rules; codes, links, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import compare, links, pricing, tables
from ..operators.staging import new_path
from ..sources import connectors
from .registry import query, table

_KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_VERSIONS = """v AS (SELECT p_partkey // 40 AS page_id, p_partkey AS pos, p_type AS label, p_type || ' ' || p_name AS name, CAST(2000 + p_size AS INTEGER) AS year, CASE WHEN p_partkey % 9 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 100 END AS price FROM part WHERE p_partkey // 40 % 5 <> 0),
d AS (SELECT *, min(pos) OVER (PARTITION BY page_id, lower(name)) AS first_at FROM v QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY price IS NULL, pos) = 1)"""


def _pages(spark, sf_dir, apart: bool):
    """A page for each forty parts; every fifth page names its versions without a label or, where apart, is blank."""
    k = F.col("p_partkey")
    page = F.floor(k / 40)
    name = F.when(page % 5 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    price = F.when(k % 9 == 0, "9.000.000").otherwise(text.thousands(F.floor("p_retailprice") * 100))
    row = F.concat(F.lit("<li><b>"), name, F.lit("</b>\n <i>"), F.col("p_name"), F.lit("</i> "), (2000 + F.col("p_size")).cast("string"), F.lit("<br>por R$ "), price, F.lit("</li>"))
    p = table(spark, sf_dir, "part").select(page.alias("page_id"), F.struct(k, row.alias("row")).alias("r"))
    rows = p.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "\n").alias("html"))
    return rows.withColumn("html", F.when((F.col("page_id") % 10 == 0) & F.lit(apart), " ").otherwise(F.concat(F.lit("<html><ul>"), F.col("html"), F.lit("</ul></html>"))))


def _rules(one: bool) -> connectors.LineUp:
    return connectors.LineUp("Brand", _KINDS, one_for_each_label=one)


@query(f"WITH {_VERSIONS} SELECT page_id, name, year, price FROM d")
def lineup_versions(spark, sf_dir):
    """Every version that a page of several models names."""
    return connectors.versions(_pages(spark, sf_dir, False), _rules(False))[0].select("page_id", "name", "year", "price")


@query(f"WITH {_VERSIONS} SELECT page_id, name, year, price FROM d QUALIFY row_number() OVER (PARTITION BY page_id, label ORDER BY year DESC, len(string_split(name, ' ')) DESC, first_at) = 1")
def lineup_current(spark, sf_dir):
    """The current version of each label; pages are files that the connector reads."""
    path = new_path(spark)
    pages = _pages(spark, sf_dir, False).withColumnRenamed("html", "value")
    pages.write.option("maxRecordsPerFile", 1).partitionBy("page_id").text(path)
    good, _ = connectors.read(spark, path, _rules(True), "*.txt")
    return good.select(F.regexp_extract("file", "page_id=([0-9]+)/", 1).cast("bigint").alias("page_id"), "name", "year", "price")


@query("SELECT DISTINCT p_partkey // 40 AS page_id, CASE WHEN p_partkey // 40 % 10 = 0 THEN 'blank' ELSE 'no_label' END AS reason FROM part WHERE p_partkey // 40 % 5 = 0")
def lineup_rejected(spark, sf_dir):
    """Pages without a version, and why."""
    return connectors.versions(_pages(spark, sf_dir, True), _rules(True))[1]


@query("""WITH r AS (SELECT p_partkey, p_partkey % 2 = 0 AS reply, CASE WHEN p_partkey % 7 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS price, CASE WHEN p_partkey % 5 <> 0 THEN 'maio de ' || (2000 + p_size % 30) END AS month, p_name, p_size FROM part)
SELECT p_partkey, CASE WHEN reply THEN 'c-' || p_partkey ELSE printf('%06d', p_partkey % 1000000) || '-' || p_partkey % 10 END AS code, price, month, CAST(CASE WHEN NOT reply THEN 2000 + p_size % 30 END AS INTEGER) AS year, CASE WHEN NOT reply THEN 'diesel' END AS fuel, CASE WHEN NOT reply THEN p_name END AS model,
nullif(concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN month IS NULL THEN 'month' END), '') AS reason FROM r""")
def price_pages(spark, sf_dir):
    """Saved price pages and replies of a price service under one reading, with what they lack."""
    k = F.col("p_partkey")
    year = (2000 + F.col("p_size") % 30).cast("string")
    price = F.when(k % 7 != 0, F.concat(F.lit("R$ "), text.thousands(F.floor("p_retailprice")), F.lit(",00")))
    month = F.when(k % 5 != 0, F.concat(F.lit("maio de "), year))
    code = F.concat(F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("-"), (k % 10).cast("string"))
    row = lambda label, v: F.coalesce(F.concat(F.lit(f"{label}: "), v), F.lit("-"))
    page = F.concat_ws("\n", F.lit("# Preço R$ 1,00"), row("Modelo", F.col("p_name")), row("Código tabela", code), row("Referência", month), row("Ano", F.concat(year, F.lit(" Diesel"))), row("Preço", price))
    reply = F.concat(F.lit("saved reply\n---\n"), F.to_json(F.struct(F.concat(F.lit("c-"), k.cast("string")).alias("code"), price.alias("price"), month.alias("month"))))
    got = connectors.price_page(F.when(k % 2 == 0, reply).otherwise(page), F.lit("https://prices.example/"))
    return tables.dealt(table(spark, sf_dir, "part")).select("p_partkey", got.alias("g")).select("p_partkey", "g.code", "g.price", "g.month", "g.year", "g.fuel", "g.model", "g.reason")


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'foreign_address' WHEN p_partkey % 7 = 0 THEN 'year_not_stated' END AS reason, p_name, p_size, p_brand FROM part)
SELECT p_partkey, label, value, reason FROM s, LATERAL (VALUES ('name', p_name), ('size', p_size || ' mm'), ('brand', CASE WHEN p_partkey % 3 <> 0 THEN p_brand END)) t(label, value) WHERE reason IS NULL AND value IS NOT NULL
UNION ALL SELECT p_partkey, NULL, NULL, reason FROM s WHERE reason IS NOT NULL""")
def sheet_cells(spark, sf_dir):
    """Cells of third-party sheets, two by two, of pages under the right address that state the year; the others' reasons."""
    k = F.col("p_partkey")
    url = F.concat(F.when(k % 11 == 0, "https://sheets.example.org/").otherwise("https://www.sheets.example/"), k.cast("string"))
    sheet = F.concat(F.lit("Ficha\nAno  "), (2000 + F.col("p_size") + (k % 7 == 0).cast("int")).cast("string"), F.lit("\n\n| **name** | "), F.col("p_name"), F.lit(" | size | "), F.col("p_size").cast("string"), F.lit(" mm |\n|---|\n| brand | "), F.when(k % 3 == 0, "–").otherwise(F.col("p_brand")), F.lit(" | |"))
    pages = table(spark, sf_dir, "part").select("p_partkey", url.alias("url"), sheet.alias("text"), (2000 + F.col("p_size")).alias("year"))
    good, bad = connectors.sheet_pairs(pages, "sheets.example", F.col("year"), "p_partkey")
    none = F.lit(None).cast("string")
    return good.select("p_partkey", "label", "value", none.alias("reason")).unionByName(bad.select("p_partkey", none.alias("label"), none.alias("value"), "reason"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 <> 1 AND p_partkey % 6 <> 0 AND p_size % 4 <> 0 THEN CAST((1 + p_size % 9) * 12 AS INTEGER) END AS months,
CASE WHEN p_partkey % 10 = 1 THEN 'no_proof' WHEN p_partkey % 6 = 0 THEN 'changed' WHEN p_size % 4 = 0 THEN 'no_clause' END AS reason FROM part""")
def warranty_claims(spark, sf_dir):
    """Months of warranty from papers whose digest is on record, and why others claim nothing."""
    k, years = F.col("p_partkey"), (1 + F.col("p_size") % 9).cast("string")
    subject = F.when(F.col("p_size") % 4 == 0, "other thing").otherwise(F.col("p_name"))
    paper = F.concat(F.lit("Manual\nGarantia contratual "), subject, F.lit(" 2024: "), years, F.lit(" anos.\nRevisão a cada 1 ano."))
    papers = table(spark, sf_dir, "part").select("p_partkey", paper.alias("text"), F.col("p_name").alias("model"), F.lit(2024).alias("year"))
    digests = papers.where(k % 10 != 1).select("p_partkey", F.sha2(F.when(k % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    claims, bad = connectors.warranty(papers, digests, "p_partkey")
    return claims.select("p_partkey", "months", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("p_partkey", F.lit(None).cast("int").alias("months"), "reason"))


@query("""SELECT p_partkey, field, num, unit, stage, CAST(tier AS INTEGER) AS tier, quote FROM part, LATERAL (VALUES
('market_price', CASE WHEN p_partkey % 4 <> 0 THEN floor(p_retailprice) END, 'BRL', 'commercial', 2, '"price":"R$ ' || CAST(floor(p_retailprice) AS BIGINT) || ',00"'),
('urban', p_size + 0.5, 'km/l', 'consumption', 2, 'Faz ' || p_size || ',5 km/l na cidade e ' || (p_size + 2) || ' km/l'), ('highway', p_size + 2.0, 'km/l', 'consumption', 2, 'Faz ' || p_size || ',5 km/l na cidade e ' || (p_size + 2) || ' km/l'),
('list_price', CASE WHEN p_partkey % 3 <> 0 THEN floor(p_retailprice) END, 'BRL', 'list_price', 1, p_name || ' R$ ' || CAST(floor(p_retailprice) AS BIGINT))) t(field, num, unit, stage, tier, quote) WHERE num IS NOT NULL""")
def service_claims(spark, sf_dir):
    """Claims of the price service, the register of consumption and the maker's list, each with its own words."""
    k, whole = F.col("p_partkey"), F.floor("p_retailprice")
    part = table(spark, sf_dir, "part")
    price = F.concat(F.lit("R$ "), whole.cast("string"), F.lit(",00"))
    replies = part.select("p_partkey", F.to_json(F.struct(k.cast("string").alias("code"), F.when(k % 4 != 0, price).alias("price"))).alias("body"))
    said = F.concat(F.lit("Ano 2024. Faz "), F.col("p_size").cast("string"), F.lit(",5 km/l na cidade e "), (F.col("p_size") + 2).cast("string"), F.lit(" km/l na estrada."))
    prices = part.select("p_partkey", F.when(k % 3 != 0, whole).alias("price"), F.concat("p_name", F.lit(" R$ "), whole.cast("string")).alias("quote"))
    return connectors.service_claims(replies, part.select("p_partkey", said.alias("text")), prices, "p_partkey").select("p_partkey", "field", "num", "unit", "stage", "tier", "quote")


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_name").alias("version"))


@query("""WITH s AS (SELECT p_brand, p_type, p_name, min(printf('%08d', p_partkey)) AS code FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT p_partkey AS id, code FROM part LEFT JOIN s USING (p_brand, p_type, p_name)""")
def catalogue_trio(spark, sf_dir):
    """The code stored under just brand, model and version; near names don't count."""
    r = _requests(spark, sf_dir)
    return pricing.by_trio(r, r.where("id % 3 = 0").select("brand", "model", "version", F.lpad(F.col("id").cast("string"), 8, "0").alias("code"))).select("id", "code")


@query()
def price_code_resolution(spark, sf_dir):
    """A price table's code for every version: seeded, stored, from a saved page, or by near spelling in the brand's list."""
    r = _requests(spark, sf_dir)
    code = F.lpad(F.col("id").cast("string"), 8, "0").alias("code")
    seeded = r.where("id % 13 = 0").select(F.upper(F.concat_ws(" - ", "brand", "model", "version")).alias("name"), code)
    stored, pages = r.where("id % 11 = 0").select("brand", "model", "version", code), r.where("id % 7 = 0").select("id", code)
    listed = r.where("id % 5 <> 0").select("brand", F.concat(F.col("model"), F.lit(" "), F.regexp_replace("version", "([a-z]{3})(?= |$)", "$1s")).alias("name"), F.concat(F.substring("model", 1, 1), F.xxhash64("brand", "model", "version").cast("string")).alias("code"))
    return pricing.price_codes(r, seeded, stored, pages, listed)


@query(r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages WHERE html IS NOT NULL),
l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || hrefs[i] AS link, titles[i] AS title, i FROM a, LATERAL (SELECT unnest(generate_series(1, len(hrefs))) AS i)),
t AS (SELECT * FROM l WHERE regexp_matches(title, '^[a-mA-M]') QUALIFY row_number() OVER (PARTITION BY page_id, lower(regexp_replace(regexp_replace(regexp_replace(link, '^[A-Za-z]+://', ''), '^www\.', ''), '/+$', '')) ORDER BY i) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS place, link AS url, title FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 4""")
def document_links(spark, sf_dir):
    """The first four links of each page whose title begins with a letter up to m."""
    return links.document_links(table(spark, sf_dir, "pages"), "page_id", "html", "url", 4, "^[a-mA-M]")


@query("""WITH e AS (SELECT p_name AS n, list_sort(list(DISTINCT p_type)) AS tags FROM part WHERE p_partkey % 3 = 0 AND p_size < 10 GROUP BY 1),
f AS (SELECT p_name AS n, list_sort(list(DISTINCT t)) AS tags FROM (SELECT p_name, p_type AS t FROM part WHERE p_partkey % 3 = 0 AND p_size < 10 UNION ALL SELECT p_name, p_brand FROM part WHERE p_partkey % 3 = 1 AND p_size < 20) GROUP BY 1)
SELECT p_partkey, coalesce(e.tags, f.tags, []) AS tags FROM part LEFT JOIN e ON e.n = p_name LEFT JOIN f ON f.n = p_name""")
def purpose_tags(spark, sf_dir):
    """Declared tags by a version's very name, then by its folded name; none are inferred."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    declared = part.where((k % 3 == 0) & (F.col("p_size") < 10)).select(F.col("p_name").alias("version"), F.col("p_type").alias("tag")).unionByName(
        part.where((k % 3 == 1) & (F.col("p_size") < 20)).select(F.upper("p_name").alias("version"), F.col("p_brand").alias("tag")))
    return compare.declared_tags(part.select("p_partkey", F.col("p_name").alias("version")), declared).select("p_partkey", "tags")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' WHEN p_size % 3 = 0 THEN 'given in metres with 1 decimal(s); millimetres add no precision' ELSE 'given in metres with 2 decimal(s); millimetres add no precision' END AS note FROM part""")
def precision_notes(spark, sf_dir):
    """A caveat on lengths that their source gives in metres."""
    size = F.col("p_size").cast("string")
    quote = F.concat(F.lit("long "), F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("00 mm"))).when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(",5 m"))).otherwise(F.concat(size, F.lit(".25 m"))))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.precision_note(F.lit("length_mm"), quote).alias("note"))
