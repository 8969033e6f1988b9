"""Connectors, links, codes and tags on stated cases and against plain loops."""

from __future__ import annotations

import hashlib
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from factloom.functions.numbers import precision_note
from factloom.operators import compare, links, pricing
from factloom.sources import connectors

RULES = connectors.LineUp("Maker", ("XL", "XLS", "Storm"))


def by(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_line_up_pages(spark):
    pages = spark.createDataFrame([
        (1, "<h1>Storm 4WD <b>2024</b></h1><p>Storm 3.0 V6 4WD 2026 desde R$ 300.000</p><p>XLS 2.2 2025 R$ 99</p>"),
        (1, "<h1>Storm 4WD <b>2024</b></h1><p>Storm 3.0 V6 4WD 2026 desde R$ 300.000</p><p>XLS 2.2 2025 R$ 99</p>"),
        (2, "XL 2.0 2025 soon. xl 2.0 2025 nothing. XL 2.0 2025 R$ 200.000 and XL 2.0 CD 2025 R$ 9.000.000"),
        (3, "XL without a year"), (4, "nothing at all 2025"), (5, None), (6, ""), (7, "XL Storm 2025")], "page_id int, html string")
    good, bad = connectors.versions(pages, RULES)
    assert by(good.where("page_id = 1"), "name", "year", "price") == [("Storm 3.0 V6 4WD", 2026, 300000), ("XLS 2.2", 2025, None)]
    assert [tuple(r) for r in good.where("page_id = 2").select("name", "price").collect()] == [("XL 2.0 CD", None)]
    assert by(good.where("page_id = 7"), "name") == [("Storm",)]
    assert by(bad, "page_id", "reason") == [(3, "no_year"), (4, "no_label"), (5, "blank"), (6, "blank")]
    every, _ = connectors.versions(pages, connectors.LineUp("Maker", RULES.labels, one_for_each_label=False))
    assert by(every.where("page_id = 2"), "name") == [("XL 2.0",), ("XL 2.0 CD",)]
    assert every.where("page_id = 2 and name = 'XL 2.0'").first()["price"] == 200000
    assert by(every.where("page_id = 1"), "quote")[0] == ("Storm 3.0 V6 4WD 2026 R$ 300.000",)
    empty = connectors.versions(pages.limit(0), RULES)
    assert empty[0].count() == empty[1].count() == 0


def test_line_up_files(spark, tmp_path):
    for name, text in (("a", "XL 2.0 2025 R$ 200.000"), ("b", "no version")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "page.html").write_text(text)
    good, bad = connectors.read(spark, str(tmp_path), RULES)
    assert [(r["file"].split("/")[-2], r["name"], r["brand"]) for r in good.collect()] == [("a", "XL 2.0", "Maker")]
    assert [(r["file"].split("/")[-2], r["reason"]) for r in bad.collect()] == [("b", "no_label")]


def test_price_pages(spark):
    texts = [
        ("Código tabela: 002215-2\nReferência: setembro de 2026\nAno: 2026 Diesel\nPreço: R$ 289.990,00", ("002215-2", 289990, "setembro de 2026", 2026, "diesel", None)),
        ('# head\n---\n{"code": "1-2", "price": "R$ 10,00", "month": "maio"}\n', ("1-2", 10, "maio", None, None, "month?")), ("Preço sugerido", (None, None, None, None, None, "price,month")), (None, (None, None, None, None, None, "price,month"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string").select("i", connectors.price_page(F.col("t"), F.lit("u")).alias("g")).orderBy("i")
    for row, (_, want) in zip(df.collect(), texts, strict=True):
        g = row["g"]
        assert (g["code"], g["price"], g["month"], g["year"], g["fuel"]) == want[:5]
        assert g["reason"] == (None if want[1] else "price,month")
    assert df.first()["g"]["quote"] == "Preço: R$ 289.990,00"


def test_sheets(spark):
    pages = spark.createDataFrame([
        (1, "https://www.sheets.example/a", "Ano  2026\n| **Power** | 200 cv | Doors | - |\n| Torque | 50 kgfm | | x |\n|---|\n| alone |"), (2, "https://evil-sheets.example/a", "Ano 2026\n| a | b |"),
        (3, "https://sheets.example/a", "Ano 2025\n| a | b |"), (4, "https://sheets.example/a", None), (5, None, "Ano 2026"), (6, "https://sheets.example/", "Ano 2026")], "page_id int, url string, text string")
    good, bad = connectors.sheet_pairs(pages, "sheets.example", F.lit(2026))
    assert by(good, "page_id", "label", "value", "line") == [(1, "Power", "200 cv", 1), (1, "Torque", "50 kgfm", 2)]
    assert by(bad, "page_id", "reason") == [(2, "foreign_address"), (3, "year_not_stated"), (4, "year_not_stated"), (5, "foreign_address")]
    assert connectors.sheet_pairs(pages, "sheets.example", F.lit(None).cast("int"))[0].count() == 0


def test_warranty(spark):
    text = "Garantia contratual Storm+ 2026: 5 anos\nGarantia contratual Storm+ 2026: 5 anos\nGarantia Other 2026: 3 anos\nGarantia Storm+ 2025: 2 anos"
    sha = hashlib.sha256(text.encode()).hexdigest()
    papers = spark.createDataFrame([(1, text, "Storm+", 2026), (2, text, "Storm", 2024), (3, text, "Storm+", 2026), (4, text, "Storm+", 2026), (5, None, "Storm+", 2026)], "doc_id int, text string, model string, year int")
    proofs = spark.createDataFrame([(1, sha), (2, sha), (3, sha[::-1]), (5, sha)], "doc_id int, sha256 string")
    claims, bad = connectors.warranty(papers, proofs)
    assert [r["doc_id"] for r in claims.collect()] == [1] and claims.first()["months"] == 60
    assert by(bad, "doc_id", "reason") == [(2, "no_clause"), (3, "changed"), (4, "no_proof"), (5, "changed")]


@pytest.mark.parametrize("base", ["https://h.example/a/b/c.html?x=1#y", "http://h.example", "https://h.example/a/"])
@pytest.mark.parametrize("href", ["d.pdf", "/d.pdf#p2", "//o.example/d", "../d", "./d?q=1", "../../../d/../e", "https://o.example/d#x", "?q=2", "mailto:a@b", "d/"])
def test_absolute(spark, base, href):
    got = spark.range(1).select(links.absolute(F.lit(href), F.lit(base))).first()[0]
    assert got == urljoin(base, href).split("#")[0]


def test_document_links(spark):
    html = '<a class="x" href="/t.pdf#p">one</a> <a href="HTTPS://h.example/t.pdf?utm_source=a">again</a> <a href="s.html">Ficha <b>técnica</b></a> <a href="p.png">catálogo</a> <a href="ftp://h/x.pdf">x</a> <a href="https://u@h/x.pdf">x</a> [data sheet](m.html "t") ![catálogo](n.html) [plain](o.html)'
    pages = spark.createDataFrame([(1, html, "https://h.example/d/"), (2, None, "https://h.example/"), (3, html, None)], "page_id int, html string, url string")
    got = links.document_links(pages, "page_id", "html", "url")
    assert [tuple(r) for r in got.orderBy("page_id", "place").collect()][:3] == [(1, 1, "https://h.example/t.pdf", "one"), (1, 2, "https://h.example/d/s.html", "Ficha técnica"), (1, 3, "https://h.example/d/m.html", "data sheet")]
    assert links.document_links(pages.where("page_id = 1"), "page_id", "html", "url", 2).count() == 2


def test_price_codes(spark):
    req = spark.createDataFrame([(1, "B", "Storm", "XL 2.0"), (2, "B", "Storm", "XLS"), (3, "B", "Storm", "Tie"), (4, "C", "Moon", "GT"), (5, "B", "Storm", "Limited Diesel"), (6, "B", "Storm", "Nowhere Land"), (7, "B", "Storm", "Page"), (7, "B", "Storm", "Page")], "id int, brand string, model string, version string")
    seeded = spark.createDataFrame([("STORM xl 2.0", "s2"), ("storm XL 2.0", "s1")], "name string, code string")
    stored = spark.createDataFrame([("B", "Storm", "XLS", "t1"), ("C", "Storm", "XL 2.0", "t2")], "brand string, model string, version string, code string")
    pages = spark.createDataFrame([(7, "p1"), (1, "p2")], "id int, code string")
    listed = spark.createDataFrame([("B", "Storm Limitd Diesel", "l1"), ("B", "Storm Tie", "l2"), ("B", "STORM TIE", "l3"), ("B", "Planet Express", "l4")], "brand string, name string, code string")
    got = {r["id"]: (r["code"], r["origin"], r["reason"]) for r in pricing.price_codes(req, seeded, stored, pages, listed).collect()}
    assert got == {1: ("s1", "seeded", None), 2: ("t1", "stored", None), 3: (None, None, "ambiguous"), 4: (None, None, "no_list"), 5: ("l1", "list", None), 6: (None, None, "unknown"), 7: ("p1", "page", None)}
    assert pricing.price_codes(req, seeded, stored, pages, listed).count() == 8
    assert pricing.price_codes(req.limit(0), seeded, stored, pages, listed).count() == 0


def test_tags_and_notes(spark):
    rng = random.Random(7)
    names = ["Ágil X", "agil x", "Big", "big", "None", ""]
    declared = [(rng.choice(names[:4]), rng.choice("abc")) for _ in range(5)] + [("none", None)]
    plain = {n: sorted({t for v, t in declared if v == n}) for n in {v for v, _ in declared}}
    folded = lambda x: x.lower().replace("á", "a")
    df = compare.declared_tags(spark.createDataFrame([(n,) for n in [*names, None]], "version string"), spark.createDataFrame(declared, "version string, tag string"))
    for r in df.collect():
        want = plain.get(r["version"]) if r["version"] in plain and r["version"] != "none" else sorted({t for v, t in declared if r["version"] and folded(v) == folded(r["version"]) and t})
        assert r["tags"] == want, r
    notes = spark.createDataFrame([("width_mm", "1,9 m wide"), ("width_mm", "1900 mm"), ("width", "1,9 m"), (None, "1,9 m"), ("width_mm", None)], "f string, q string").select(precision_note(F.col("f"), F.col("q")))
    assert [bool(r[0]) for r in notes.collect()] == [True, False, False, False, False]
