"""What keeps queries within their limits on large tables, read from their plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import catalogue
from factloom.functions import numbers, text
from factloom.operators import decide, extract, grid, ground, identity, labels, scope, tables
from factloom.sources import captures

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def dealt(spark, name: str) -> bool:
    return "RoundRobinPartitioning" in catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_columns_of_grids_meet_no_broadcast_of_headings(spark):
    g = spark.createDataFrame([(1, 0, 0, 1, ""), (1, 0, 1, 1, "A"), (1, 1, 0, 1, "x"), (1, 1, 1, 1, "5"), (2, 0, 1, 1, "A"), (2, 0, 2, 1, " a "), (2, 1, 1, 1, "6"), (None, 0, 1, 1, "A"), (None, 1, 1, 1, "7")], grid.CELL)
    out = grid.column_of(g, "table_id", "A")
    assert "Join" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "x", "5")]


def test_lines_of_a_line_up_do_not_carry_its_text(spark):
    t = spark.createDataFrame([("Head\n\n| a | 2020 | R$ 1.000 | u |\nx\n| b | 2021 | R$ 2.000 | v |",)], "text string")
    out = captures.lineup(t)
    above, below = plan(out).split("Generate", 1)
    assert "regexp_extract(text" not in above and "regexp_extract(text" in below
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2020, 1000, "u", "Head"), ("b", 2021, 2000, "v", "Head")]


def test_numbers_name_their_text_once(spark):
    d = spark.createDataFrame([("x -1.234.567,5 y",), ("-123.456",), ("12.345",), ("1234.567",), ("1.234.5678",)], "t string")
    out = d.select(numbers.parse_number(F.concat("t", F.lit(" "))).alias("n"))
    assert plan(out).count("concat(") == 1
    assert [r["n"] for r in out.collect()] == [-1234567.5, -123.456, 12345.0, 1234.567, 1234.0]
    assert dealt(spark, "price_pages")


def test_identity_reads_each_text_once(spark):
    d = spark.createDataFrame([("b m 2.0 2020 brasil", "https://x.com.br", "b", "m", "2.0", 2020)], "t string, u string, b string, m string, v string, y int")
    out = d.select(identity.identity(F.concat("t", F.lit(" ")), *[F.col(c) for c in "ubmvy"]).alias("i"))
    assert plan(out).count("concat(t") == 1 and out.first()["i"]["state"] == "compatible"
    assert dealt(spark, "document_identity")


def test_labels_split_a_text_once(spark):
    d = spark.createDataFrame([(1, "Power\n\n5 kW\nPower\nPower")], "doc_id long, text string")
    out = labels.next_line_pairs(d, ["power"])
    assert plan(out).count("split(text") <= 4  # once for the lines, the rest for whether they are a table
    assert [tuple(r) for r in out.collect()] == [(1, 0, "Power", "5 kW")]
    assert dealt(spark, "label_facts")


def test_values_are_worked_out_once(spark):
    d = spark.range(1).select(labels.normalised(F.lit("number"), F.concat(F.col("id").cast("string"), F.lit("5 kw")), F.lit("power")).alias("n"))
    assert plan(d).count("concat(cast(id") == 1
    assert d.first()["n"]["num"] == 7.0 and dealt(spark, "typed_values")


def test_observations_are_shuffled_once_to_their_tier(spark):
    obs = spark.createDataFrame([("a", "f", 1.0, "s", 1, "q"), ("a", "f", 1.0, "t", 1, "q"), ("a", "f", None, "u", 1, "r"), ("a", "f", 1.0, None, 1, "r"), ("b", "f", None, "s", 1, "q")], "entity string, field string, num double, source string, tier int, quote string")
    d = decide.decide(obs, spark.createDataFrame([("f", 0.0, None)], "field string, tol_abs double, tol_rel double"))
    assert "Expand" not in plan(d)
    assert sorted((r["entity"], r["independent"], r["n_best"], r["status"]) for r in d.collect()) == [("a", 2, 3, "verified"), ("b", 0, 0, "declared_absent")]


def test_claims_are_made_once_to_be_located(spark):
    c = spark.createDataFrame([(1, "blue ring", "a blue  ring"), (2, "blue rinq sold here today", "a blue ring sold here today"), (3, " ", "x"), (4, "x", None), (5, "zzz qqq", "a blue ring")], "k int, quote string, source_text string")
    out = ground.locate(c)
    assert "Union" not in plan(out)
    assert sorted((r["k"], r["mode"], r["score"] > 92) for r in out.collect()) == [(1, "exact", True), (2, "fuzzy", True), (3, "no_quote", False), (4, "no_text", False), (5, "failed", False)]


def test_headings_are_found_inside_the_row(spark):
    d = spark.createDataFrame([(1, "## XL 2026\n\t\nItem  A\nXLT 3,0\nPacotes de opcionais:\nitem"), (2, "no head"), (3, None)], "doc_id long, text string")
    out = scope.headings(d)
    assert not any(x in plan(out) for x in ("Generate", "Window", "Aggregate"))
    heads = {r["doc_id"]: r["heads"] and [(h["at"], h["level"], h["option"], h["names"]) for h in r["heads"]] for r in out.collect()}
    # The line of a tab is blank in the text that places count in.
    assert heads == {1: [(0, 2, False, ["xl"]), (18, None, False, ["xlt"]), (26, None, True, None)], 2: [], 3: None}
    claims = d.select("doc_id", F.lit("xl").alias("version"), F.lit("item").alias("quote"), F.lit(False).alias("asks_option"))
    assert plan(scope.claim_scope(claims, d)).count("Join") == 1


def test_texts_are_folded_once(spark):
    assert plan(catalogue.QUERIES["text_fold_slug"](spark, FOLDER)).count("translate(lower(") == 1
    d = spark.createDataFrame([(" A  b\u00a0c\t“Ç”–Ý\n",), ("\tA \n",), ("",), (None,)], "t string")
    got = [tuple(r) for r in d.select(text.squeeze(F.col("t")), text.fold(F.col("t")), text.slug(F.col("t")), text.tokens(F.col("t"), ["a"])).collect()]
    assert got == [('a b c "ç"-ý', 'a b c "c"-y', "a_b_c_c_y", ["b", "c", "c", "y"]), ("a", "a", "a", ["a"]), ("", "", "x", []), (None, None, None, None)]


def test_lines_without_a_rules_signs_are_not_searched(spark):
    d = spark.createDataFrame([(1, "no sign\na@b.com cost US$ 5 in 2020, 1.2.3.4\n€7 http://x/y"), (2, None), (3, "")], "doc_id long, text string")
    for places in (False, True):
        out = extract.facts(d, places=places)
        assert "Contains(line" in plan(out)
        assert sorted((r["pos"], r["rule"], r["value"]) for r in out.collect()) == [
            (1, "amount", "5"), (1, "email", "a@b.com"), (1, "network", "1.2.3.4"), (1, "year", "2020"), (2, "address", "http://x/y"), (2, "amount", "7")]
    assert [r["value"] for r in extract.facts(d, [("sign", "sign", 0)], places=False).collect()] == ["sign"]


def test_pages_reach_python_by_few_rows(spark):
    out = spark.createDataFrame([("<p>a&amp;b</p><script>x</script><td>c",), (None,)], "h string").select(extract.html_text(F.col("h")).alias("t"))
    assert "BatchEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["t"] for r in out.collect()] == ["a&b\nc", None]


def test_tasks_of_a_large_table_stay_small(spark):
    rows = spark.range(10).select("id", F.lit("a").alias("k"))
    assert tables.in_parts(rows, 3_000_001, "id").rdd.getNumPartitions() == 7 and tables.in_parts(rows, 10, "id").rdd.getNumPartitions() == 4
    executed = catalogue.QUERIES["cells_before_text"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in executed


def test_groups_of_values_reach_python_as_arrow(spark):
    nan, rows = float("nan"), [(None, "f", 1), (None, "f", 2), (1, "f", 3), (1, "g", 1), (1, "f", 1)]
    obs = [(e, f, x, t) for e, f, t in rows for x in (0.0, 5.0, 0.5, -3.0, nan, 5.0, None)]
    spec = spark.createDataFrame([("f", 1.0, None), ("h", None, 0.5)], "field string, tol_abs double, tol_rel double")
    out = decide.value_groups(spark.createDataFrame([*obs, (2, "h", -4.0, 1), (2, "h", -2.0, 1), (2, "h", 2.0, 2), (2, "h", 3.0, 1)], "entity bigint, field string, num double, tier int"), spec)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {(e, f): [(str(x["num"]), x["grp"]) for x in sorted((x for x in seen if (x["entity"], x["field"]) == (e, f)), key=lambda x: (x["tier"], x["num"] != x["num"], x["num"]))] for seen in [out.collect()] for e, f in {(x["entity"], x["field"]) for x in seen}}
    # Values of a missing entity are grouped together as any other's.
    assert got[None, "f"] == got[1, "f"] == [("-3.0", 0), ("0.0", 1), ("0.5", 1), ("5.0", 2), ("nan", 0)] * 2
    assert [k for _, k in got[1, "g"]] == [0, 1, 2, 3, 0] and got[2, "h"] == [("-4.0", 0), ("-2.0", 0), ("3.0", 1), ("2.0", 1)]
