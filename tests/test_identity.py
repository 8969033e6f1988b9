"""Provenance and identity: cases worked out by hand beside those of the queries, and odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import identity, provenance


def test_odd_quotes(spark):
    df = spark.createDataFrame([(None, None), ("", ""), ("camera", None)], "item string, quote string")
    got = df.select(
        provenance.refusal(F.lit("power"), F.col("quote")).alias("r"), provenance.items_affirmed(F.array("item"), F.col("quote")).alias("i"), provenance.date_bound("price_date", F.lit("2024-01-01"), F.col("quote")).alias("d"),
        identity.identity(F.col("quote"), F.col("quote"), F.lit("Ford"), F.lit("Ranger"), F.lit("XL"), F.lit(None).cast("int")).alias("v"), identity.mentions(F.col("item"), F.col("quote")).alias("m"),
    ).collect()
    assert [r["r"] for r in got] == [None] * 3
    assert not got[2]["i"] and not any(r["d"] for r in got)
    assert {r["v"]["state"] for r in got} == {"insufficient"} and {tuple(r["v"]["reasons"]) for r in got} == {("brand", "model", "market", "version")}
    assert not any(r["m"] for r in got)


def test_items_by_clause(spark):
    rows = [("Não possui piloto automático nem câmera", "camera", False), ("Piloto automático: ausente", "piloto automatico", False), ("Sem teto. Câmera de ré", "camera", True), ("Câmera (a.b) [c", "(a.b)", True), ("câmera ausente; câmera de série", "camera", True)]
    df = spark.createDataFrame(rows, "quote string, item string, want boolean")
    got = df.select("want", provenance.items_affirmed(F.array("item"), F.col("quote")).alias("got"), "quote").collect()
    assert [(r["quote"], r["got"]) for r in got] == [(r["quote"], r["want"]) for r in got]


def test_longer_names_first(spark):
    one = lambda t: spark.range(1).select(identity.versions_named(F.lit(t))).first()[0]
    assert one("Limited Plus e XLT") == ["limited plus", "xlt"]
    assert one("SRX Plus, SRX") == ["srx", "srx plus"]
    assert one("xlarge blackout") == []


def test_years_by_model(spark):
    one = lambda t: spark.range(1).select(identity.model_years(F.lit(t), F.lit("Ranger"))).first()[0]
    assert one("Ranger 2024\nMaverick 2023\nCopyright 2022") == [2024]
    assert one("Linha 2025 de Maverick\nRanger captura 2020") == [2025]


def test_fields_need_two_owners(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "a", None)], "s int, f string, o string")
    assert [tuple(r) for r in identity.fields_by_version(df, "s", "f", "o").collect()] == [(1, "a", 2)]


# -- stated cases
REFUSED = [  # field, quote, reason
    ("suggested_price", "Fixar veículo R$ 199.900", "listing_price"), ("tyre_use", "Pneus 265/60 R18", "size_is_no_use"), ("tyre_use", "Pneus 265/60 R18 All-Terrain", None),
    ("rim_inches", "SYNC 4 com tela de 12 polegadas", "screen_is_no_rim"), ("rim_inches", "Tela SYNC e rodas aro 18", None), ("width_mm", "2.180 mm com espelhos", "width_with_mirrors"),
    ("power", "Potência combinada de 700 cv", "combined_power"), ("displacement", "Óleo do motor 6,0 L", "fluid_capacity"), ("warranty_months", "3 anos; pintura 12 meses", "component_warranty"),
    ("tyre", "Rodas opcionais, pneu opcional", "optional_item"), ("suggested_price", "Entrada de 50% e parcelas", "conditional_offer"), ("colours", "Entrada de 50%", None),
]
ITEMS = [  # items, quote, affirmed
    ("piloto automatico", "Tem piloto automático; sem câmera", True), ("camera", "Tem piloto automático; sem câmera", False), ("camera", "Sem câmera, mas câmera na versão de topo", True),
    ("alerta de faixa,camera", "Alerta de faixa. Câmera: não disponível", False), ("aeb", "Frenagem autônoma de emergência", True), ("camera", "camerata", False), ("", "nada", True),
]
NAMES = {"aeb": ["frenagem autonoma de emergencia", "frenagem automatica"]}
DATES = [  # field, value, quote, bound
    ("price_date", "2024-08-15", "Preço sugerido válido em 15/08/2024", True), ("price_date", "2024-08-15", "Preços vigentes em 15/08/2024", True), ("price_date", "2024-08-15", "Captura em 15/08/2024", False),
    ("price_date", "2024-02-31", "Preços vigentes em 31/02/2024", False), ("price_date", "2024-08-15", "Publicado em 1/1/2023; preços válidos: 15 de agosto de 2024", True), ("reference_month", "2024-03", "Mês de referência: março de 2024", True),
    ("reference_month", "2024-03", "Tabela FIPE 03/2024", True), ("reference_month", "2024-02", "Tabela FIPE 31/02/2024", False), ("reference_month", "2024-04", "Tabela FIPE 03/2024", False),
]
TARGET = ("Ford", "Ranger", "Limited 3.0 V6 4WD AT", 2024)
TEXTS = [  # text, url, state, reasons
    ("Ford Ranger Limited 3.0 V6 2024\nMercado brasileiro", "https://www.ford.com.br/picapes", "compatible", ""), ("Ford Ranger Limited 2024\nBrasil", "", "insufficient", "engine"),
    ("Ford Ranger XLT 2.0 2024\nBrasil", "", "incompatible", "engine,version"), ("Ford Ranger Limited 3.0 2022\nBrasil", "", "incompatible", "year"), ("Ford Ranger Limited 3.0 2024\nTração: 4x2", "https://x.com/br/y", "incompatible", "driven_wheels"),
    ("Ford Ranger Limited 3,0 2024\nCâmbio manual", "https://ford.com.au/ranger", "incompatible", "market,gearbox"), ("Ford Ranger Limited 3.0\nBrasil. Captura 2024", "", "insufficient", "year"), ("", "", "insufficient", "brand,model,market,engine,year,version"),
]
QUOTES = [("XLS", "Versão XLS com rodas", None), ("XLS", "XL e XLS", "other_version"), ("Limited", "Limited Plus com teto", "other_version"), ("Limited", "motor 3.0", None), ("Série 1", "XL", None)]
RECORDS = [  # record, brand, year, reason
    ("Ranger Limited 3.0 V6 4WD Dies. Aut.", "Ford", 2024, None), ("Ranger Limited 2.0 4x4 Aut.", "Ford", 2024, "engine"), ("Maverick Limited 3.0", "Ford", 2024, "model"), ("Ranger Limited 3.0", "VW", 2024, "brand"),
    ("Ranger XLT 3.0 V6", "Ford", 2024, "version"), ("Ranger Limited 3.0 V6", "", 2023, "year"), ("", "Ford", 2024, "no_name"),
]
CLAIMS = [("A marca declara 5,8 s", "", "declared"), ("", "6,5 s (teste X)", "measured"), ("declarado; medimos 6,5 s", "", "measured"), ("0-100 km/h: 5,8 s", "", None)]


def told(spark, rows, schema, got):
    """got of each row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["got"] for r in df.select("i", got.alias("got")).orderBy("i").collect()]


def test_stated_quotes(spark):
    c = F.col
    assert told(spark, [r[:2] for r in REFUSED], "f string, q string", provenance.refusal(c("f"), c("q"))) == [r[2] for r in REFUSED]
    shop = provenance.refusal(c("f"), c("q"), url=c("u"))
    assert told(spark, [("tyre", "Pneu", "https://acessorios.x.com"), ("power", "397 cv", "https://acessorios.x.com"), ("tyre", "Pneu", None)], "f string, q string, u string", shop) == ["optional_item", None, None]
    items = F.filter(F.split(c("x"), ","), lambda x: x != "")
    assert told(spark, [r[:2] for r in ITEMS], "x string, q string", provenance.items_affirmed(items, c("q"), NAMES)) == [r[2] for r in ITEMS]
    both = F.when(c("f") == "price_date", provenance.date_bound("price_date", c("v"), c("q"))).otherwise(provenance.date_bound("reference_month", c("v"), c("q")))
    assert told(spark, [r[:3] for r in DATES], "f string, v string, q string", both) == [r[3] for r in DATES]
    assert told(spark, [r[:2] for r in CLAIMS], "q string, raw string", text.claim(c("raw"), c("q"))["kind"]) == [r[2] for r in CLAIMS]


def test_stated_identities(spark):
    c, (brand, model, version, year) = F.col, map(F.lit, TARGET)
    v = identity.identity(c("t"), c("u"), brand, model, version, year)
    assert told(spark, [r[:2] for r in TEXTS], "t string, u string", F.concat_ws(":", v["state"], F.array_join(v["reasons"], ","))) == [f"{s}:{r}" for _, _, s, r in TEXTS]
    assert told(spark, [r[:2] for r in QUOTES], "v string, q string", identity.claim_refused(c("v"), c("q"))) == [r[2] for r in QUOTES]
    assert told(spark, [r[:3] for r in RECORDS], "r string, b string, y int", identity.record_refused(c("r"), c("b"), c("y"), brand, model, version, year)) == [r[3] for r in RECORDS]
