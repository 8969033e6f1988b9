"""Sections of claims, blocks read again, keyed writes, rounds, quantiles from counts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.operators import rounds, scope
from factloom.sources import sinks
from factloom.streaming import monitor, reading


# -- sections
def refused(spark, text, *claims):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    c = spark.createDataFrame([(i, 1, *x) for i, x in enumerate(claims)], "i int, doc_id int, version string, quote string, asks_option boolean")
    return [r["refused"] for r in scope.claim_scope(c, docs).orderBy("i").collect()]


def test_a_quote_belongs_to_its_section(spark):
    text = "intro airbag\n\n# XL 2026\nseat A\n## Pacote opcional\nseat B\n### Detail\nseat C\n## Outros\nseat D\n# XLT 3.0\nseat E\nshared\n# XL 2025\nshared\nKit opcional XL 2.0\nseat F\n"
    xl = lambda q, option=False: ("Ranger XL", q, option)
    got = refused(spark, text, xl("intro airbag"), xl("seat a"), xl("Seat B"), xl("seat B", True), xl("seat C"), xl("seat D"), xl("seat E"), xl("shared"), xl("seat F"), xl("seat F", True), xl("seat A of the XLT"), xl("nowhere"), xl(""), ("Ranger", "seat E", None), ("Ranger XLT", "seat A", False), ("XL", None, None))
    assert got == [None, None, "option_section", None, "option_section", None, "other_version_section", None, "option_section", None, "other_version", None, None, None, "other_version_section", None]


def test_options_inside_options_and_versions_inside_them(spark):
    text = "# XL 2026\nqa\n## Pacotes de opcionais\nqb\n### Pacote opcional\nqc\n### XLT 2026\nqd\n## Fim\nqe"
    assert refused(spark, text, *[("XL", f"q{x}", False) for x in "abcde"]) == [None, "option_section", "option_section", "other_version_section", None]
    assert refused(spark, text, *[("XL", f"q{x}", True) for x in "abcde"]) == [None, None, None, "other_version_section", None]


def test_a_claim_of_no_document(spark):
    c = spark.createDataFrame([(9, "XL", "x", False), (None, "XL", "the XLT", None)], "doc_id int, version string, quote string, asks_option boolean")
    docs = spark.createDataFrame([(9, None), (8, "XLT 2026\nx")], "doc_id int, text string")
    assert {r["doc_id"]: r["refused"] for r in scope.claim_scope(c, docs).collect()} == {9: None, None: "other_version"}


# -- blocks
SCHEMA = "doc_id bigint, version bigint, text string"


def test_reading_resumes(spark, tmp_path):
    r = random.Random(3)
    texts = {i: [f"{i} {r.random()}" for _ in range(r.randrange(1, 9))] for i in range(12)}
    folder, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))

    def deliver(version, which):
        spark.createDataFrame([(i, version, "\n".join(texts[i])) for i in which], SCHEMA).repartition(2).write.mode("append").parquet(folder)

    def read():
        before = set(spark.read.parquet(out).drop("batch").collect()) if (tmp_path / "out").exists() else set()
        seen = {tuple(x) for x in before}
        reading.read_changes(spark, folder, SCHEMA, out, log, lines=2)
        now = [tuple(x) for x in spark.read.parquet(out).drop("batch").collect()] if (tmp_path / "out").exists() else []
        for x in seen:
            now.remove(tuple(x))
        return now

    def twin(old, new):
        b = lambda t: reading.blocks(spark.createDataFrame([(i, 0, "\n".join(x)) for i, x in t.items()], SCHEMA), 2)
        return sorted((tuple(x) for x in reading.changed_blocks(b(old), b(new)).collect()), key=str)

    deliver(1, texts)
    first = read()
    assert {x[3] for x in first} == {"new"} and len(first) == sum(-(-len(t) // 2) for t in texts.values())
    assert read() == []
    deliver(2, texts)
    assert read() == []  # delivered again, nothing new
    old = {i: list(t) for i, t in texts.items()}
    texts[0][0] = "changed"
    deliver(3, [0, 1])
    assert read() == twin({i: old[i] for i in (0, 1)}, {i: texts[i] for i in (0, 1)}) != []
    old = {i: list(t) for i, t in texts.items()}
    texts[5] = texts[5][:1]
    texts[6] += ["more", "and", "more"]
    deliver(4, [5, 6])
    assert sorted(read(), key=str) == twin({i: old[i] for i in (5, 6)}, {i: texts[i] for i in (5, 6)})
    deliver(2, [7])  # an older version than was read
    assert read() == []


# -- keyed writes
VALUES = "k int, at int, value string, quote string, located boolean"


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, VALUES)
    stored = lambda: sorted(tuple(r) for r in spark.read.parquet(path).drop("bucket").collect())
    held = sinks.upsert(df((1, 1, "a", "q", True), (2, 1, "b", " ", True), (3, 1, "c", "q", False), (4, 1, None, None, None), (None, 1, "x", "q", True)), path, ["k"], ["at"], 4)
    assert sorted((r["k"] or 0, r["reason"]) for r in held.collect()) == [(0, "no key"), (2, "no quote"), (3, "quote not located")]
    assert stored() == [(1, 1, "a", "q", True), (4, 1, None, None, None)]
    for _ in range(2):
        sinks.upsert(df((1, 3, "new", "q", True), (1, 2, "older", "q", True), (5, 1, "e", "q", True)), path, ["k"], ["at"], 4)
        assert stored() == [(1, 3, "new", "q", True), (4, 1, None, None, None), (5, 1, "e", "q", True)]
    sinks.upsert(df((1, 2, "late", "q", True)), path, ["k"], ["at"], 4)
    assert stored()[0] == (1, 3, "new", "q", True)
    broken = df((1, 9, "z", "q", True)).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException, match="lost"):
        sinks.upsert(broken, path, ["k"], ["at"], 4)
    assert stored()[0] == (1, 3, "new", "q", True)
    assert sinks.upsert(df(), path, ["k"], ["at"], 4).count() == 0


# -- rounds
def test_rounds_stop_for_a_reason(spark):
    wanted = spark.createDataFrame([(i, f) for i in range(4) for f in "ab"] + [(None, "a"), (0, "a")], "entity int, field string")
    steps = []

    def search(gaps, k):
        steps.append((k, gaps.count()))
        return wanted.dropna().where(F.col("entity") == k - 1).selectExpr("entity", "field", f"{k} as value", "2.0 as cost")

    run = lambda budget, f=search, **kw: rounds.fill_gaps(wanted, ["entity", "field"], f, budget, **kw)
    out = run(rounds.Budget(rounds=9))
    assert out.stop == "no_gap" and steps == [(1, 8), (2, 6), (3, 4), (4, 2)] and out.gaps.count() == 0
    assert [(r.number, r.found, r.left, r.cost) for r in out.rounds] == [(1, 2, 6, 4.0), (2, 2, 4, 4.0), (3, 2, 2, 4.0), (4, 2, 0, 4.0)]
    assert sorted((r["entity"], r["value"], r["round"]) for r in out.known.collect()) == sorted((i, i + 1, i + 1) for i in range(4) for _ in "ab")
    assert run(rounds.Budget(rounds=2)).stop == "rounds" and run(rounds.Budget(rounds=9, cost=8)).stop == "cost"
    ticks = iter([0.0, 0.0, 5.0])
    assert run(rounds.Budget(rounds=9, seconds=5), clock=lambda: next(ticks)).stop == "seconds"
    nothing = run(rounds.Budget(rounds=9), lambda gaps, k: search(gaps, 99))
    assert nothing.stop == "no_progress" and nothing.gaps.count() == 8 and nothing.known.count() == 0
    assert rounds.fill_gaps(wanted.limit(0), ["entity", "field"], search, rounds.Budget(rounds=3)).stop == "no_gap"
    assert run(rounds.Budget(rounds=0)).stop == "rounds"


# -- quantiles
def test_quantiles_from_counts(spark):
    r = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=r.randrange(600)), r.choice([None, 0.0, 1.0, 2.5, r.random() * 50])) for _ in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    g = df.groupBy(F.window("ts", "1 hour")["start"].alias("window_start")).agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.9), 4).alias("p"))
    assert sorted(map(tuple, monitor.percentile_windows(df, "1 hour", 0.9).collect())) == sorted(map(tuple, g.collect()))
    edges = [1.0, 5.0, 10.0, 20.0]

    def by_hand(values):
        rank, past, low = 0.9 * len(values), 0, 0.0
        for e in edges:
            upto = sum(v is not None and v <= e for v in values)
            if upto >= rank and upto > past:
                return round(low + (e - low) * (rank - past) / (upto - past), 4)
            past, low = upto, e
        return edges[-1]

    got = {x["window_start"]: (x["n"], x["p"]) for x in monitor.bucket_quantile(df, "1 hour", 0.9, edges).collect()}
    for w, (n, p) in got.items():
        values = [v for t, v in rows if t.replace(minute=0) == w]
        assert n == len(values) and p == pytest.approx(by_hand(values))
