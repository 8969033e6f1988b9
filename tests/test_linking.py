"""Values near anchors, near spellings, matched lists: against plain loops."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy, matching
from factloom.operators import near, spelling

RULES = [("s", r"0 a 100", r"([0-9]+(?:,[0-9]+)?) s\b", 30, 2.0, 60.0), ("w", r"(?i)weight|mass", r"([0-9]+) kg", 12, 1.0, 900.0)]


def by_hand(doc_id, text):
    out = []
    for part, body in enumerate(re.split(r"\n\s*\n", text)):
        for field, anchor, value, reach, low, high in RULES:
            anchors = [(m.start(), m.end(), m[0]) for m in re.finditer(anchor, body)]
            for v in re.finditer(value, body):
                best = None
                for a, b, hit in anchors:
                    side = "before" if a <= v.start() else "behind"
                    gap = max(0, v.start() - b) if side == "before" else max(0, a - v.end())
                    if best is None or (gap, side) < best[:2]:
                        best = (gap, side, hit)
                num = float(v[1].replace(",", "."))
                if best and best[0] <= reach and low <= num <= high:
                    out.append((doc_id, part, field, v[1], num, v.start(), best[2], best[0], best[1]))
    return out


def test_values_by_anchor(spark):
    r = random.Random(4)
    bits = ["0 a 100", "5,8 s", "6,5 s", "1 s", "70 s", "Weight", "mass", "40 kg", "999 kg", "\n", "\n\n", "\n \n", " ", "é𝒳 ", "and so on ", "words "]
    rows = [(i, "".join(r.choices(bits, k=r.randrange(0, 25)))) for i in range(250)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("part", F.lit(9)).withColumn("name", F.lit("n"))
    got = near.values_by_anchor(df, RULES).collect()
    assert sorted(tuple(x[:9]) for x in got) == sorted(y for i, t in rows for y in by_hand(i, t or ""))
    text = dict(rows)
    assert len(got) > 100 and all(x["quote"] in text[x["doc_id"]] and x["value"] in x["quote"] for x in got)
    best = near.nearest_by_value(near.values_by_anchor(df, RULES)).collect()
    assert len(best) == len({(x["doc_id"], x["field"], x["num"]) for x in got}) and sum(x["n_found"] for x in best) == len(got)


def test_near_words_are_those_of_the_full_scan(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcde", k=r.randrange(1, 13))) for _ in range(150)]
    words += ["".join(w[:i] + w[i + 1 :]) for w in words[:80] for i in [r.randrange(len(w))]] + ["ranger", "rangr", "a" * 30, "a" * 27 + "b" * 5]
    asked, known = words[::2], words[1::2] + words[:20]
    df = lambda w: spark.createDataFrame([(x,) for x in w], "word string")
    for least in (85, 70):
        got = spelling.near_words(df(asked), df(known), least)
        assert {(x["asked"], x["known"]) for x in got.collect()} == {(a, b) for a in asked for b in known if a and b and fuzzy.ratio(a, b) >= least}
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())
    with pytest.raises(ValueError, match="70"):
        spelling.near_words(df(asked), df(known), 60)


def scan(query, names):
    """The resolver by holding the query against every name."""
    words = fuzzy.folded(query).split()
    rows = sorted(((round(fuzzy.coverage(words, fuzzy.folded(n).split()), 4), 100.0 if fuzzy.folded(n) == fuzzy.folded(query) else fuzzy.set_ratio(query, n), n) for n in names), reverse=True)
    cover, score, name = rows[0]
    if cover == 0:
        return "unknown", None, 0.0, None
    weak, n = cover < 0.75 or score < 85, sum(x[:2] == (cover, score) for x in rows)
    outcome = "unknown" if weak else "ambiguous" if n > 1 else "found"
    return outcome, name if outcome == "found" else None, cover, score


def test_resolve_is_the_full_scan(spark):
    r = random.Random(8)
    words = ["ranger", "raptor", "limited", "plus", "xl", "xls", "tremor", "black", "wildtrak", "cabine", "dupla", "3.0"]
    names = sorted({" ".join(r.sample(words, r.randrange(1, 5))) for _ in range(120)})
    queries = {" ".join(w[:i] + w[i + r.randrange(2) :] if r.random() < 0.4 else w for w in r.choice(names).split() for i in [r.randrange(len(w))]) for _ in range(120)} | {"", "zzz", "Limited", "RANGER  raptor"}
    got = spelling.resolve(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(n,) for n in names + names[:5]], "n string"), "q", "n")
    assert {x["query"]: tuple(x[1:]) for x in got.collect()} == {q: scan(q, names) for q in queries}
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())


def test_resolve_within_a_scope(spark):
    names = spark.createDataFrame([("ring", "a"), ("ring", "b"), ("rings", "c")], "n string, brand string")
    q = spark.createDataFrame([("ring", "a"), ("ring", "c"), ("ring", "d"), ("ring", None)], "q string, brand string")
    assert {x["brand"]: (x["outcome"], x["name"]) for x in spelling.resolve(q, names, "q", "n", within=["brand"]).collect()} == {"a": ("found", "ring"), "c": ("found", "rings"), "d": ("unknown", None), None: ("unknown", None)}


def test_suggestions_of_near_spellings(spark):
    names = spark.createDataFrame([("ranger xl", 2025), ("ranger xl", 2026), ("ranger raptor", 2026), ("hilux", 2026)], "name string, year int")
    q = spark.createDataFrame([("rangr",), ("rangr xl 2025",), ("zzz",)], "q string")
    got = [(x["q"], x["name"], x["year"], x["place"], x["tied"]) for x in spelling.suggest_near(q, "q", names, "name", 5, "year").orderBy("q", "place").collect()]
    assert got == [("rangr", "ranger xl", 2026, 1, False), ("rangr", "ranger xl", 2025, 2, False), ("rangr", "ranger raptor", 2026, 3, False), ("rangr xl 2025", "ranger xl", 2025, 1, False), ("rangr xl 2025", "ranger xl", 2026, 2, False), ("rangr xl 2025", "ranger raptor", 2026, 3, False)]
    tied = spelling.suggest_near(spark.createDataFrame([("ring",)], "q string"), "q", spark.createDataFrame([("red ring",), ("hot ring",)], "name string"), "name", 1).first()
    assert (tied["name"], tied["tied"]) == ("hot ring", True)


def test_lists_are_matched_as_well_as_can_be():
    r = random.Random(1)
    for _ in range(300):
        n, m = r.randrange(0, 6), r.randrange(0, 6)
        edges = [[j for j in range(m) if r.random() < 0.4] for _ in range(n)]
        got = matching.assign(edges, m)
        used = [j for j in got if j >= 0]
        assert len(set(used)) == len(used) and all(j in edges[i] for i, j in enumerate(got) if j >= 0)
        best = max((sum(j in edges[i] for i, j in zip(range(n), p, strict=False)) for p in itertools.permutations(list(range(m)) + [-1] * n, n)), default=0)
        assert len(used) == best
    # Taking the first likeness for 'park assist' would leave 'assist' without a partner.
    assert matching.match(["park assist", "assist"], ["assist rear", "park"])[1:] == ([], [])
    assert matching.match(["a", "A", " "], ["a"]) == ([("a", "a")], [], [])
    assert matching.match(["lane keeping", "radio"], ["keeping lane", "tv"]) == ([("lane keeping", "keeping lane")], ["radio"], ["tv"])


def test_match_lists(spark):
    df = spark.createDataFrame([(["x ray", "y"], ["Y", "ray x"]), (None, ["a"]), ([], None), (["a", None], ["b"])], "e array<string>, g array<string>")
    got = [tuple(r["m"]) for r in df.select(matching.match_lists("e", "g", F.lit(72.0)).alias("m")).collect()]
    assert got == [(True, ["y = y", "x ray = ray x"], [], []), (False, [], [], ["a"]), (True, [], [], []), (False, [], ["a"], ["b"])]
