"""Queries of provenance and identity: quotes, documents and records are made of the rows of `part`, and the SQL says from
the columns what must come out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, provenance, tables
from .registry import query, table


def _columns() -> tuple[Column, ...]:
    """First and last word of a part's name, its size, whether that is odd, whether three divide it."""
    size = F.col("p_size")
    return F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), size, size % 2 == 1, size % 3 == 0


def _t(*parts: Column | str) -> Column:
    """Texts and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT p_partkey, field, CASE field WHEN 'suggested_price' THEN CASE WHEN p_size % 2 = 1 THEN 'listing_price' WHEN p_size % 3 = 0 THEN 'conditional_offer' END WHEN 'tyre_use' THEN CASE WHEN p_size % 2 = 1 THEN 'size_is_no_use' END
WHEN 'rim_inches' THEN CASE WHEN p_size % 2 = 1 THEN 'screen_is_no_rim' WHEN p_size % 3 = 0 THEN 'optional_item' END ELSE CASE WHEN p_size % 5 = 0 THEN 'optional_item' END END AS reason
FROM (SELECT *, ['suggested_price', 'tyre_use', 'rim_inches', 'tyre'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS field FROM part)""")
def quote_refusals(spark, sf_dir):
    """Why a quote cannot carry a value of its field."""
    _, _, size, odd, third = _columns()
    price = F.floor("p_retailprice")
    quotes = F.array(
        F.when(odd, _t("Fixar veículo R$ ", price)).when(third, _t("Entrada de R$ ", price)).otherwise(_t("Por R$ ", price)), _t("Pneus ", 200 + size, "/60 R18", F.when(odd, "").otherwise(" All-Terrain")),
        F.when(odd, _t("Multimídia de ", size, '"')).when(third, _t("Aro ", size, " opcional")).otherwise(_t("Multimídia, aro ", size)), _t("Pneu ", size))
    k = F.pmod("p_partkey", F.lit(4)).cast("int")
    d = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("suggested_price", "tyre_use", "rim_inches", "tyre"))), k).alias("field"), F.get(quotes, k).alias("quote"), F.when((k == 3) & (size % 5 == 0), "https://acessorios.x.com/").otherwise("https://x.com/acessorios").alias("url"))
    return d.select("p_partkey", "field", provenance.refusal(F.col("field"), F.col("quote"), url=F.col("url")).alias("reason"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE p_size % 2 = 1 END AS affirmed FROM part")
def affirmed_items(spark, sf_dir):
    """Whether a quote affirms an item, under any of its names, in a clause that doesn't deny it."""
    first, last, size, odd, _ = _columns()
    quote = F.when(odd, _t("Tem ", first, "; sem ", last, ". Alerta de faixa")).otherwise(_t("Tem ", first, ". Não possui ", last, ", mas sem alerta de faixa"))
    item = F.when(size % 3 == 0, first).when(size % 3 == 1, last).otherwise("lka")
    return table(spark, sf_dir, "part").select("p_partkey", provenance.items_affirmed(F.array(item), quote, {"lka": ["alerta de faixa"]}).alias("affirmed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size % 2 = 1 AND p_size % 3 <> 0 AND p_size % 32 BETWEEN 1 AND 31 ELSE p_size % 2 = 1 AND p_size % 3 <> 0 AND p_size % 13 BETWEEN 1 AND 12 END AS bound FROM part")
def bound_dates(spark, sf_dir):
    """Whether a quote binds a date to its price or reference month; days and months that no calendar has bind nothing."""
    _, _, size, odd, third = _columns()
    day, month = F.lpad((size % 32).cast("string"), 2, "0"), F.lpad((size % 13).cast("string"), 2, "0")
    other = F.when(third, "2023").otherwise("2024")
    price = provenance.date_bound("price_date", _t("2024-01-", day), F.when(odd, _t("Preços vigentes em ", day, "/01/", other)).otherwise(_t("Captura em ", day, "/01/", other)))
    months = provenance.date_bound("reference_month", _t("2024-", month), F.when(odd, _t("Tabela FIPE ", month, "/", other)).otherwise(_t("Artigo de ", month, "/", other)))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, price).otherwise(months).alias("bound"))


@query("""WITH r AS (SELECT p_partkey, p_size % 4 = 0 AS a, p_size % 3 = 0 AS b, p_size % 5 = 0 AS c, p_size % 7 = 0 AS d, p_size % 11 = 0 AS e FROM part)
SELECT p_partkey, CASE WHEN a OR b OR c THEN 'incompatible' WHEN d OR e THEN 'insufficient' ELSE 'compatible' END AS state,
CASE WHEN a OR b OR c THEN concat_ws(',', CASE WHEN a THEN 'market' END, CASE WHEN b THEN 'engine' END, CASE WHEN c THEN 'year' END) ELSE concat_ws(',', CASE WHEN d THEN 'brand' END, CASE WHEN e THEN 'version' END) END AS reasons FROM r""")
def document_identity(spark, sf_dir):
    """Whether a document speaks of the version asked for, and what contradicts it or is left out."""
    first, last, size, _, third = _columns()
    litres, year = _t(1 + size % 7, ".", size % 10), 2000 + size
    said = _t(F.col("p_brand"), " ", first, " ", last, " ", litres, " ", year, "\n", F.when(size % 4 == 0, "Mercado: Argentina").otherwise("Mercado brasileiro"))
    wanted = _t(F.when(size % 11 == 0, "quattroporte").otherwise(last), " ", F.when(third, "8.9").otherwise(litres))
    v = identity.identity(said, F.lit("https://x.com/y"), F.when(size % 7 == 0, "Other").otherwise(F.col("p_brand")), first, wanted, (F.when(size % 5 == 0, 1).otherwise(0) + year).cast("int"))
    return tables.dealt(table(spark, sf_dir, "part")).select("p_partkey", v.alias("v")).select("p_partkey", "v.state", F.array_join("v.reasons", ",").alias("reasons"))


_WORDS = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod", "small", "widget"]


@query("""SELECT a.p_partkey, CASE WHEN list_sort(string_split(a.p_name, ' ')) <> list_sort(string_split(b.p_name, ' ')) THEN 'other_version' END AS reason FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def claim_identity(spark, sf_dir):
    """Quotes that name other versions than the one asked for: each part's name against the next one's."""
    first, last, _, _, _ = _columns()
    p = table(spark, sf_dir, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), _t("The ", F.upper(last), ", ", first, " anvils").alias("quote"))
    return p.join(after, "p_partkey").select("p_partkey", identity.claim_refused(F.col("p_name"), F.col("quote"), _WORDS).alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN 'no_name' WHEN p_size % 4 = 0 THEN 'engine' WHEN p_size % 5 = 0 THEN 'model' WHEN p_size % 7 = 0 THEN 'brand' WHEN p_size % 3 = 0 THEN 'version' WHEN p_size % 2 = 1 THEN 'year' END AS reason FROM part""")
def price_record_identity(spark, sf_dir):
    """Why a price record is not that of the version asked for."""
    first, last, size, odd, third = _columns()
    record = F.when(size % 13 == 0, " ").otherwise(_t(first, " ", last, " 3.0 Aut."))
    version = _t(F.when(third, "quattroporte").otherwise(last), F.when(size % 4 == 0, " 2.0").otherwise(" 3.0"))
    reason = identity.record_refused(record, F.when(size % 7 == 0, "Other").otherwise(F.col("p_brand")), 2000 + size, F.col("p_brand"), F.when(size % 5 == 0, "encabulator").otherwise(first), version, F.when(odd, 1999).otherwise(2000 + size))
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'measured' WHEN p_size % 3 = 1 THEN 'declared' WHEN p_size % 2 = 1 THEN 'measured' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'medimos' WHEN p_size % 3 = 1 THEN 'declara' WHEN p_size % 2 = 1 THEN 'teste' END AS term FROM part""")
def claim_types(spark, sf_dir):
    """Whether a quote says that its value was measured or declared, and by which word; measured weighs more."""
    first, _, size, odd, third = _columns()
    raw = F.when((size % 3 == 2) & odd, _t(size, ",5 s (teste)")).otherwise("")
    quote = F.when(third, _t("A marca declara ", size, " s; medimos ", size + 1)).when(size % 3 == 1, _t("O ", first, " declara ", size, " s")).otherwise(_t("0 a 100 km/h: ", size, " s"))
    return table(spark, sf_dir, "part").select("p_partkey", text.claim(raw, quote).alias("c")).select("p_partkey", "c.kind", "c.term")


@query("SELECT page_id, contains(regexp_replace(lower(url), '[^a-z0-9]+', '', 'g'), 'examplecom') AS mentioned FROM pages WHERE url IS NOT NULL")
def mentions_model(spark, sf_dir):
    """Pages whose address has a model's letters and digits in a row."""
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", identity.mentions(F.lit("Example-Com"), F.col("url")).alias("mentioned"))


@query("WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, CAST(pos AS BIGINT) AS pos, pos || ':' || sha256(block) AS block_id FROM b")
def reading_blocks(spark, sf_dir):
    """A stable name for every block of a text: its position and the digest of what it says."""
    b = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))
    return b.select("doc_id", F.col("pos").cast("bigint").alias("pos"), text.block_id(F.col("pos"), F.col("block")).alias("block_id"))


@query("SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS n_versions FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2")
def fields_by_version(spark, sf_dir):
    """Fields that a source states for several owners apart."""
    return identity.fields_by_version(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey"), "l_orderkey", "l_returnflag", "l_suppkey")
