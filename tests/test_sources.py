from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import captures, sinks


def test_capture_tree(spark, tmp_path):
    for folder, meta in {
        "a/2024": {"source_id": "s1", "version_id": "v", "url_final": "https://www.x.org/p/?utm_source=q", "tier": 2, "captured_at": "2024-01-01T00:00:00", "bytes": 5},
        "a/2025": {"source_id": "s2", "version_id": "v", "url_final": "http://x.org/p", "tier": 3, "captured_at": "2025-01-01T00:00:00", "bytes": 1},
    }.items():
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "meta.json").write_text(json.dumps(meta, indent=1))
        (tmp_path / folder / "page.md").write_text("line one\nline two")
    found = captures.captures(spark, str(tmp_path))
    assert [r["source_id"] for r in captures.best_captures(found).collect()] == ["s2"]
    assert [r["source_id"] for r in captures.captures_of(found, "v").collect()] == ["s1", "s2"]
    texts = captures.source_texts(spark, str(tmp_path)).join(found, "folder")
    assert {r["text"] for r in texts.collect()} == {"line one\nline two"} and texts.count() == 2


def test_import_tells_why_rows_go(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿version;field;value\na;power;397\nb;;1\n")
    good, bad = captures.import_table(spark, str(tmp_path / "t.csv"), ["version", "field"])
    assert [r["value"] for r in good.collect()] == ["397"] and [r["reason"] for r in bad.collect()] == ["empty: field"]
    (tmp_path / "t.json").write_text('{"version": "a", "field": "f"}\n{"version": "b"\n')
    good, bad = captures.import_table(spark, str(tmp_path / "t.json"), ["version", "field"], "json")
    assert good.count() == 1 and [r["reason"] for r in bad.collect()] == ["cannot be parsed"]
    with pytest.raises(ValueError, match="columns missing: nope"):
        captures.import_table(spark, str(tmp_path / "t.csv"), ["nope"])


def test_lineup_and_replies(spark):
    t = spark.createDataFrame([("Line-up of x\ndate 2026\n\n| name | year | price | url |\n|---|---|---|---|\n| LTD | 2026 | R$ 499.000 | http://x/1 |\n| LTD+ | 2027 | - | |",)], "text string")
    assert [(r["name"], r["year"], r["price"]) for r in captures.lineup(t).collect()] == [("LTD", 2026, 499000), ("LTD+", 2027, None)]
    s = spark.range(1).select(captures.consumption_sentences(F.lit("faz 8,5 km/l na cidade e 10,2 km/l na estrada.")).alias("c"), captures.price_reply(F.lit('{"code": "1-2", "price": "R$ 348.790", "month": "maio"}')).alias("p")).first()
    assert [tuple(x) for x in s["c"]] == [(8.5, 10.2)] and (s["p"]["code"], s["p"]["price"], s["p"]["quote"]) == ("1-2", 348790, '"price": "R$ 348.790"')
    b = spark.createDataFrame([(b"\xef\xbb\xbfabc",), ("ção".encode("cp1252"),), ("ção".encode(),)], "b binary")
    assert [r[0] for r in b.select(captures.decoded(F.col("b"))).collect()] == ["abc", "ção", "ção"]


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("a", 1.0, "q", True), ("b", 1.0, " ", True), ("c", 2.0, "q", False), ("d", None, None, None)], "field string, value double, quote string, located boolean")
    ok, held = sinks.gated(v)
    assert {r["field"] for r in ok.collect()} == {"a", "d"} and {(r["field"], r["reason"]) for r in held.collect()} == {("b", "no quote"), ("c", "quote not located")}
    sinks.write_csv(ok, str(tmp_path / "csv"), ["simulated rows are left out"])
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv/rows")).count() == 2
    sinks.write_long(v, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).count() == 4
    sinks.write_captures(spark.createDataFrame([("v", "text")], "version_id string, text string"), str(tmp_path / "cap"))
    assert len(spark.read.parquet(str(tmp_path / "cap")).first()["sha256"]) == 64
    assert "PARTITIONED BY (field)" in sinks.table_definition(v, "t", "field", ["value"])
    m = spark.createDataFrame([({"b": "2", "a": "1"}, 3.0)], "labels map<string,string>, value double")
    assert sinks.exposition(m, "hits").first()["line"] == 'hits{a="1",b="2"} 3'
