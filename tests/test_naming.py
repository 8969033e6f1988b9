"""Names found in texts, requests, ids, scopes, cells: against plain loops and stated cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import grid, naming


def plain(text):
    return f" {re.sub('[^a-z0-9]+', ' ', text.lower()).strip()} "


def by_hand(rows, names):
    out = []
    for i, text in rows:
        t = plain(text)
        hits = []
        for n in {plain(x) for x in names if plain(x).strip()}:
            at = t.find(n)
            while at >= 0:
                hits.append((at + 1, at + len(n) - 1, n.strip()))
                at = t.find(n, at + 1)
        out += [(i, n, a, b) for a, b, n in hits if not any((c, d) != (a, b) and c <= a and b <= d for c, d, _ in hits)]
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 7])
def test_find_names(spark, monkeypatch, most):
    monkeypatch.setattr(naming, "MOST_NAMES", most)
    r = random.Random(5)
    words = ["red", "ring", "ringer", "xl", "XLT", "3.0", "v6", "old"]
    names = sorted({" ".join(r.choices(words, k=r.randrange(1, 4))) for _ in range(30)}) + [" ", "!", "Red-Ring"]
    rows = [(i, r.choice(["", " ", ", "]).join(x + r.choice([" ", "-", ". "]) for x in r.choices(words + ["and", "of"], k=r.randrange(0, 20)))) for i in range(120)]
    docs = spark.createDataFrame(rows + [(999, None)], "doc_id bigint, text string").repartition(3).withColumn("name", F.lit("n")).withColumn("id", F.lit(0))
    got = naming.find_names(docs, spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    assert sorted(map(tuple, got.collect())) == by_hand(rows, names)
    assert naming.find_names(docs, spark.createDataFrame([], "name string")).count() == 0


def test_requests(spark):
    catalogue = spark.createDataFrame([("Ranger Raptor", "r1"), ("Raptor", "r1"), ("Ranger", "r1"), ("Ranger", "r2"), ("S10", "s")], "name string, entity string")
    q = spark.createDataFrame([(1, "a RANGER raptor 2026"), (2, "ranger"), (3, "s-10 or S10"), (4, "s10, raptor"), (5, None), (6, "")], "id int, text string")
    got = {r["id"]: (r["outcome"], r["entity"], r["choices"], r["year"]) for r in naming.identify(q, catalogue).collect()}
    assert got == {1: ("resolved", "r1", ["r1"], 2026), 2: ("must_choose", None, ["r1", "r2"], None), 3: ("resolved", "s", ["s"], None), 4: ("must_choose", None, ["r1", "s"], None), 5: ("not_understood", None, None, None), 6: ("not_understood", None, None, None)}


def test_explicit_requests(spark):
    texts = ["VW Amarok V6 Extreme 2025", "Volkswagen Amarok", "ford", "FORD Ranger XL", None, "Alfa Romeo 2024 Giulia Veloce Q4", "alfa romeo giulia"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    r = naming.explicit_request(F.col("t"), {"vw": "Volkswagen", "volkswagen": "Volkswagen", "ford": "Ford", "alfa": "Other", "alfa romeo": "Alfa Romeo"})
    got = [x["r"] and tuple(x["r"]) for x in d.select("i", r.alias("r")).orderBy("i").collect()]
    assert got == [("Volkswagen", "Amarok", "V6 Extreme", 2025), None, None, ("Ford", "Ranger", "XL", None), None, ("Alfa Romeo", "Giulia", "Veloce Q4", 2024), ("Other", "romeo", "giulia", None)]


def test_likely_ids(spark):
    ids = spark.createDataFrame([("ford_ranger_raptor_2026",), ("vw_amarok_v6_extreme_2026",), ("ford_ranger_xl_2026",), ("ford_ranger_xl_2025",)], "id string")
    q = spark.createDataFrame([("Ford Ranger Raptor 3.0 V6 Bi-turbo 4WD AT",), ("Volkswagen Amarok V6 Extreme",), ("Ford Ranger XL",), ("Fiat",), ("ford rangr raptr",)], "q string")
    got = {r["q"]: (r["id"], r["coverage"]) for r in naming.likely_id(q, ids, "q", "id", {"volkswagen": "vw"}).collect()}
    assert got == {"Ford Ranger Raptor 3.0 V6 Bi-turbo 4WD AT": ("ford_ranger_raptor_2026", 0.75), "Volkswagen Amarok V6 Extreme": ("vw_amarok_v6_extreme_2026", 0.8), "Ford Ranger XL": (None, 0.75), "Fiat": (None, 0.0), "ford rangr raptr": ("ford_ranger_raptor_2026", 0.75)}


def test_scopes(spark):
    rows = [("ficha", "http://x/ranger", "XL", "version"), ("page", "http://x/ranger-raptor/?q=xl#a", "Raptor 3.0", "version"), ("page", "http://x/ranger/", "Raptor", "line"), (None, None, "Raptor", "line"), ("page", "http://x/raptor", None, "line")]
    d = spark.createDataFrame(rows, "kind string, url string, version string, want string")
    assert all(r["want"] == r["got"] for r in d.withColumn("got", naming.document_scope(F.col("kind"), F.col("url"), F.col("version"), ["ficha"])).collect())


def test_cell_facts(spark):
    rules = [("power", r"^(\d+)/", 1, "power", "number", "power", "kW"), ("power", r"^(\d+)", 1, "power", "number", "power", "cv"), ("seats", r"(\d+)", 1, "seats", "count", None, ""), ("trim", r"(.+)", 1, "trim", "text", None, "")]
    rows = [(1, 0, 1, 1, "A"), (1, 0, 2, 1, "B"), (1, 1, 0, 1, "Power2"), (1, 1, 1, 2, "100/3"), (1, 1, 2, 1, " "), (1, 2, 0, 1, ""), (1, 2, 2, 1, "7"), (1, 3, 0, 1, "Seats"), (1, 3, 2, 1, "—"), (1, 4, 0, 1, "Trim (x)"), (1, 4, 2, 1, " soft  "), (2, 0, 1, 1, "B"), (2, 0, 2, 1, "b"), (2, 1, 0, 1, "Seats"), (2, 1, 1, 1, "5")]
    got = grid.cell_facts(spark.createDataFrame(rows, grid.CELL), "table_id", "b", rules).orderBy("row", "field").collect()
    assert [(r["row"], r["field"], r["quote"], r["num"], r["txt"]) for r in got] == [(1, "power", "100/3", 136.0, None), (2, "power", "7", 7.0, None), (4, "trim", " soft  ", None, "soft")]
