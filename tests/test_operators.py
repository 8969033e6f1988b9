from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import compare, decide, extract, facts, ground, quality, radar, score, spelling, tables
from factloom.plans import mapping

FACT = "entity bigint, field string, num double, flag boolean, items array<string>, txt string, status string"


def states(spark, home, competitor, field, kind):
    spec = facts.spec_table(spark, [(field, "g", kind, 1.0 if kind == "number" else None, None, "high" if kind == "number" else None, kind == "bool", kind == "list")])
    at = {"number": 0, "bool": 1, "list": 2, "text": 3}[kind]

    def row(entity, v):
        cells = [None] * 4
        cells[at] = v
        return (entity, field, *cells, "verified")

    pairs = spark.createDataFrame([(1, 2)], "home bigint, competitor bigint")
    known = spark.createDataFrame([r for r in (row(1, home), row(2, competitor)) if r], FACT)
    r = compare.parity(compare.align(known, pairs, spec)).first()
    return r["state"], r["reason"]


@pytest.mark.parametrize(("home", "competitor", "kind", "state"), [
    (397.0, 398.0, "number", "parity"), (397.0, 399.0, "number", "gap"), (0.0, 5.0, "number", "gap"), (None, 5.0, "number", "unknown"), (False, True, "bool", "gap"), (False, False, "bool", "parity"),
    (["a", "b"], ["a"], "list", "advantage"), (["a"], ["b"], "list", "unknown"), ([], ["b"], "list", "unknown"), ("LTD", "ltd ", "text", "parity"), ("LTD", "LTD+", "text", "unknown"),
])
def test_parity_states(spark, home, competitor, kind, state):
    assert states(spark, home, competitor, "f", kind)[0] == state


def test_parity_tells_which_side_is_missing(spark):
    assert states(spark, None, None, "f", "number")[1] == "no_data_on_both"
    assert states(spark, None, 1.0, "f", "number")[1] == "no_data_home"
    assert states(spark, 1.0, None, "f", "number")[1] == "no_data_competitor"
    assert states(spark, ["a"], ["b"], "f", "list")[1] == "crossing_sets"


def test_decisions(spark):
    o = spark.createDataFrame([
        (1, "f", 10.0, 1, 1, "a"), (1, "f", 10.5, 2, 1, "b"), (1, "f", 99.0, 3, 4, "c"),  # the best tier agrees, a lower one contests
        (2, "f", 10.0, 1, 2, "a"), (2, "f", 20.0, 2, 2, "b"),  # divergent
        (3, "f", None, 1, 1, "-"), (4, "f", None, 1, 4, "-"),  # absence by an official and by another source
    ], "entity bigint, field string, num double, source bigint, tier int, quote string")
    spec = facts.spec_table(spark, [("f", "g", "number", 1.0, None, "high", False, False)])
    d = {r["entity"]: r for r in decide.decide(o, spec).collect()}
    assert {k: r["status"] for k, r in d.items()} == {1: "verified", 2: "divergent", 3: "declared_absent", 4: "not_found"}
    assert d[1]["contested"] and d[1]["independent"] == 2 and d[2]["confidence"] == 0.85 and d[3]["confidence"] is None


def test_value_groups_like_the_plain_loop(spark):
    r = random.Random(5)
    rows = [(e, "f", round(r.uniform(0, 6), 1), 1, r.randrange(1, 4), "q") for e in range(20) for _ in range(r.randrange(1, 15))]
    o = spark.createDataFrame(rows, "entity bigint, field string, num double, source bigint, tier int, quote string")
    spec = facts.spec_table(spark, [("f", "g", "number", 1.0, None, "high", False, False)])
    got = {(x["entity"], x["tier"], x["num"]): x["grp"] for x in decide.value_groups(o, spec).collect()}
    for e in range(20):
        groups: list[list[float]] = []
        for t, n in sorted({(x[4], x[2]) for x in rows if x[0] == e}):
            k = next((k for k, g in enumerate(groups) if all(abs(n - y) <= 1 + 1e-9 for y in g)), len(groups))
            if k == len(groups):
                groups.append([])
            groups[k].append(n)
            assert got[e, t, n] == k


def test_history_and_merge(spark):
    h = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "k int, t int, p string")
    assert [r["t"] for r in decide.changed_only(h, ["k"], ["t"], "p").orderBy("t").collect()] == [1, 3, 4]
    a, b = spark.createDataFrame([(1, 5), (2, 5), (4, 1)], "k int, t int"), spark.createDataFrame([(1, 6), (2, 4), (3, 1)], "k int, t int")
    assert {r["k"]: r["action"] for r in decide.merge_latest(a, b, ["k"], [F.desc("t")]).collect()} == {1: "replaced", 2: "kept", 3: "inserted", 4: "unchanged"}
    log = a.withColumn("fingerprint", decide.fingerprint(F.col("k")))
    new = b.withColumn("fingerprint", decide.fingerprint(F.col("k")))
    assert [r["k"] for r in decide.append_new(log, new.union(new)).collect()] == [3]


def test_unique_top_refuses_ties(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 4), ("b", 2, 3)], "k string, v int, s int")
    assert {(r["k"], r["decided"], r["n_top"]) for r in tables.unique_top(d, ["k"], [F.desc("s")]).collect()} == {("a", False, 2), ("b", True, 1)}


def test_asof_takes_only_what_was_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 1, 30), ("a", 5, 2, 50), ("a", 5, 3, None)], "k string, t int, i int, v int")
    assert {(r["k"], r["t"]): r["v"] for r in tables.asof_before(left, right, ["k"], "t", "i", "v").collect()} == {("a", 5): 30, ("a", 6): None, ("b", 1): None}


def test_shares(spark):
    d = spark.createDataFrame([(9, 19), (9, 20), (0, 0)], "a int, n int")
    assert [r[0] for r in d.select(tables.share_from(F.col("a"), F.col("n"))).collect()] == [None, 45.0, None]
    assert [r[0] for r in d.select(tables.ratio(F.col("a"), F.col("n"))).collect()][2] is None


def test_health_rules_in_order(spark):
    rows = [(1, "divergent", 1, 1), (1, "verified", 1, 1), (1, "verified", 1, 1), (2, "not_found", 1, 1), (3, "verified", 40, 1), (4, "verified", 1, 3), (5, "verified", 1, 1)]
    h = quality.health(spark.createDataFrame(rows, "e int, status string, age_days int, tier int"), "e")
    assert {r["e"]: r["rule"] for r in h.collect()} == {1: "has_conflict", 2: "few_verified", 3: "has_stale", 4: "has_unconfirmed", 5: "nothing_open"}


def test_veto_makes_noise(spark):
    events = spark.createDataFrame([("x", 100.0, 100.9, 103.0, 0.9, 3.0, 2.1, True), ("y", 100.0, 106.0, 103.0, 6.0, 3.0, -3.0, False), ("z", 0.0, 5.0, None, None, None, None, False)],
        "key string, before double, after double, reference double, delta_pct double, gap_before double, gap_after double, heavy boolean")
    got = {r["key"]: r for r in radar.materiality(events, tables.literal(spark, radar.RULES, radar.RULE), "key").collect()}
    assert got["x"]["band"] == "NOISE" and got["x"]["rank"] > 3900 and "table_noise" in got["x"]["rules_fired"]
    assert got["y"]["band"] == "HIGH" and got["y"]["rules_fired"] == "magnitude_high" and got["z"]["band"] == "NOISE"


def test_scores(spark):
    s = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    at = lambda v, d: s(score.scaled(F.lit(v), F.lit(10.0), F.lit(20.0), F.lit(d)))
    assert (at(15.0, "high"), at(99.0, "high"), at(12.0, "low"), at(0.0, "high")) == (5.0, 10.0, 8.0, 0.0)
    p = s(score.pair_scores(F.lit(130.0), F.lit(100.0), F.lit("high")))
    assert p["home"] > 8 and round(p["home"] + p["comp"], 2) == 10
    even = s(score.pair_scores(F.lit(0.0), F.lit(0.0), F.lit("high")))
    assert even["home"] == even["comp"] == 5
    c = score.cost_of_use(spark.range(1), F.lit(1000.0), F.lit(None).cast("double"), F.lit(None).cast("double")).first()
    assert c["cost"] is None and c["lacking"] == "consumption,price"
    assert s(score.ordinal(F.lit("b"), ["a", "b", "c"])) == 5.0 and s(score.ordinal(F.lit("z"), ["a"])) is None


def test_overlay_writes_nothing_else(spark):
    known = spark.createDataFrame([(1, "f", 10.0, None, None, None, "verified"), (1, "g", 7.0, None, None, None, "verified")], FACT)
    o = spark.createDataFrame([(1, "f", 10.0, None), (1, "g", 80.0, None)], "entity bigint, field string, pct double, value double")
    assert {r["field"]: r["num"] for r in compare.overlay(known, o).collect()} == {"f": 11.0, "g": 7.0}


def test_quotes_are_found_everywhere(spark):
    docs = spark.createDataFrame([(1, "The Pôtencia  is 397cv in\nfull today"), (2, "nothing here"), (3, "the potencia is 397cv in full"), (4, None), (5, "")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "he pôtencia is 397cv in fu"), (2, "397cv"), (3, " "), (4, None), (5, "absent words that nobody wrote in any text")], "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]): r["mode"] for r in ground.locate_everywhere(quotes, docs).collect()}
    assert got == {(1, 1): "exact", (1, 3): "folded", (2, 1): "exact", (2, 3): "exact"}


def test_claims_against_their_source(spark):
    c = spark.createDataFrame([(1, "Motor 397cv", "O motor 397cv é"), (2, "Potencia 397cv", "Potência 397cv"), (3, "torque 583 nm rear axle", "a torqve 583 nm rear axle"), (4, "torque 900 nm rear axle", "a torque 583 nm rear axle"), (5, " ", "x"), (6, "x", None)], "i int, quote string, source_text string")
    assert [r["mode"] for r in ground.locate(c).orderBy("i").collect()] == ["exact", "folded", "fuzzy", "failed", "no_quote", "no_text"]


def test_numbers_need_proof(spark):
    p = lambda v, q, f=(1.0,): spark.range(1).select(ground.number_proven(F.lit(v), F.lit(q), list(f)).alias("x")).first()["x"]
    assert p(397.0, "com 397 cv") and not p(397.0, "com 379 cv") and p(262.0, "258 hp", (1.0, 1.0139)) and not p(1.0, "no number")


def test_resolver_refuses_what_it_does_not_know(spark):
    names = spark.createDataFrame([("small ring",), ("small bolt",), ("red widget",)], "p_name string")
    q = spark.createDataFrame([("red widgte",), ("small",), ("turbo",)], "query string")
    assert {r["query"]: r["outcome"] for r in spelling.resolve(q, names, "query", "p_name", least_score=50).collect()} == {"red widgte": "unknown", "small": "ambiguous", "turbo": "unknown"}
    one = spelling.resolve(spark.createDataFrame([("ring small",)], "query string"), names, "query", "p_name").first()
    assert one["outcome"] == "found" and one["name"] == "small ring"


def test_extraction(spark):
    d = spark.createDataFrame([(1, "mail a.b@c.org now\nR$ 1.234 in 2024\n***\nLabel: value"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {(r["rule"], r["value"]) for r in extract.facts(d).collect()}
    assert got == {("email", "a.b@c.org"), ("amount", "1.234"), ("year", "2024")}
    assert extract.cleaned(d).where("doc_id = 1").first()["n_removed"] == 2
    assert [(r["label"], r["value"]) for r in extract.labelled(d).collect()] == [("Label", "value")]
    html = spark.createDataFrame([("<head><title>x</title></head><p>Hello <b>you</b></p><script>no()</script><table><tr><td>a</td><td>b</td></tr></table>",), (None,)], "h string")
    assert [r[0] for r in html.select(extract.html_text("h")).collect()] == ["Hello you\na\tb", None]


def test_facts_are_quoted_and_judged_at_their_place(spark):
    long = "word " * 60
    texts = [long + "there is no mail a@b.org here", "a@b.org. " + long + "without a@b.org", "no 20015, from 2001", long + "a@b.org " + long, "é 2001 2002", long + "costs R$ 5"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    every = extract.facts(d)
    got = every.collect()
    assert all(r["line"][r["at"] - 1 :].startswith(r["value"]) and r["value"] in r["quote"] and r["quote"] in r["line"] and len(r["quote"].split()) <= 25 for r in got)
    assert {(r["doc_id"], r["value"], r["at"]) for r in got} == {(0, "a@b.org", 318), (1, "a@b.org", 1), (1, "a@b.org", 318), (2, "2001", 16), (3, "a@b.org", 301), (4, "2001", 3), (5, "5", 310)}
    assert next(r["quote"] for r in got if r["doc_id"] == 3) == "word " * 12 + "a@b.org" + " word" * 12
    assert sorted((r["doc_id"], r["at"]) for r in extract.without_negated(every).collect()) == [(1, 1), (3, 301), (4, 3), (5, 310)]


def test_every_page_is_classified_the_best_first(spark, tmp_path):
    from factloom import catalogue

    urls = [f"https://site{i:03}.org/" for i in range(120)] + [f"https://{h}/" for h in ("spam.net", "blog.a.net", "b.net")]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["url_classes"](spark, str(tmp_path)).select("page_id", "class", "tier", "accepted").collect()]
    assert got == [(i, "official", 1, True) for i in range(120)] + [(121, "press", 3, True), (122, "other", 4, True), (120, "rejected", None, False)]


def test_plans_push_filters_and_prune(spark):
    plan = mapping.sheet(spark, "/root/testdata/sf0.001").where("p_brand = 'Brand#1'").select("p_partkey", "unit_price")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#1)" in plan and "l_tax" not in plan.split("Physical Plan")[1]


def test_grids(spark):
    from factloom.operators import grid

    t = spark.createDataFrame([(1, [["", "LTD", "LTD+"], ["engine", "V6", ""], ["", "turbo", "bi"], ["doors", " ", "4"]])], "t bigint, g array<array<string>>")
    cells = grid.cells(t, "t", "g").withColumn("span", F.when(F.col("value") == "V6", 2).otherwise(1))
    got = {(r["row"], r["label"], r["value"]) for r in grid.column_of(cells, "t", "ltd+").collect()}
    assert got == {(1, "engine", "V6"), (2, "engine", "bi"), (3, "doors", "4")}
    assert grid.column_of(cells, "t", "absent").count() == 0


def test_area_counts_overlaps_once(spark):
    from factloom.operators import grid

    r = random.Random(3)
    boxes = [(k, x, y, x + r.randrange(4), y + r.randrange(4)) for k in range(5) for x, y in [(r.randrange(9), r.randrange(9)) for _ in range(8)]]
    df = spark.createDataFrame([(k, *map(float, b)) for k, *b in boxes], "k bigint, x0 double, y0 double, x1 double, y1 double")
    got = {x["k"]: x["area"] for x in grid.area_of_union(df, "k").collect()}
    for k in range(5):
        squares = {(x, y) for j, x0, y0, x1, y1 in boxes if j == k for x in range(x0, x1) for y in range(y0, y1)}
        assert got.get(k, 0) == len(squares)


def test_vocabulary(spark):
    from factloom.operators import grid

    v = tables.literal(spark, [("f", "4x4", "awd"), ("f", "biturbo", "twin_turbo")], "field string, token string, canonical string")
    rows = spark.createDataFrame([("f", "4X4"), ("f", "Bi-turbo"), ("f", "Rear Axle"), ("g", "4x4"), ("f", None)], "field string, t string")
    assert {(r["field"], r["t"]): r["canonical"] for r in grid.canonical(rows, v, "field", F.col("t")).collect()} == {("f", "4X4"): "awd", ("f", "Bi-turbo"): "twin_turbo", ("f", "Rear Axle"): "rear_axle", ("g", "4x4"): "4x4", ("f", None): None}
