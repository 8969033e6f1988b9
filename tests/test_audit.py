"""Audits and scenario differences on stated cases and against plain loops."""

from __future__ import annotations

import hashlib
import random
import re

from factloom.operators import audit, quality, score

WORDS = ["f", "150", "storm", "gt", "f150", "x", "Storm"]
GAPS = [" ", "-", "", "_", " / "]


def test_mentions_equal_a_scan(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(n))
    docs = [(i, text(rng.randrange(8))) for i in range(150)] + [(900, None), (901, "")]
    fams = [(i, " ".join(rng.choice(WORDS) for _ in range(1 + i % 3))) for i in range(12)] + [(90, "--"), (91, None), (3, "F-150")]
    got = {tuple(r) for r in audit.mentions(spark.createDataFrame(fams, "family int, model string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    want = set()
    for f, model in fams:
        words = re.findall("[a-z0-9]+", (model or "").lower())
        if words:
            p = re.compile("(?<![a-z0-9])" + "[^a-z0-9]*".join(words) + "(?![a-z0-9])")
            want |= {(f, i) for i, t in docs if p.search((t or "").lower())}
    assert got == want and len(want) > 30
    assert audit.mentions(spark.createDataFrame([], "family int, model string"), spark.createDataFrame(docs, "doc_id int, text string")).count() == 0


def test_exposure(spark):
    fams = spark.createDataFrame([("a", "Storm GT"), ("b", "Moon"), ("c", "Sun")], "family string, model string")
    used = spark.createDataFrame([(1, "Maker Storm-GT 2.0")], "id int, target string")
    texts = spark.createDataFrame([(1, "a moon and the storm gt"), (2, "moon"), (3, "moonlight")], "doc_id int, text string")
    assert sorted(tuple(r) for r in audit.exposure(fams, used, texts).collect()) == [("a", 1, 1, "used_before"), ("b", 0, 2, "review_pending"), ("c", 0, 0, "review_pending")]


def test_audit(spark):
    text = "It weighs 1.850 kg and has 4 doors."
    sha = hashlib.sha256(text.encode()).hexdigest()
    texts = spark.createDataFrame([("s", text, sha), ("s", text, sha), ("t", text, sha[::-1])], "source string, text string, sha256 string")
    claims = spark.createDataFrame([
        (1, "doors", 4.0, "4 doors", "s", "verified"), (1, "weight", 1850.0, "weighs 1.850 kg", "s", "verified"), (1, "height", 5.0, "4 doors", "s", "verified"), (1, "width", 4.0, "4 doors", "t", "verified"),
        (1, "seats", 4.0, "4 doors", "s", "unverified"), (1, "gears", 4.0, "4 doors", "s", "verified"), (1, "gears", 5.0, "4 doors", "s", "verified"), (1, "axles", 4.0, "4 doors", "s", "divergent"), (1, "lamps", None, None, None, "verified"),
        (1, "extra", 4.0, "4 doors", "s", "verified")], "entity int, field string, num double, quote string, source string, status string")
    proved = audit.proofs(claims, texts)
    assert proved.count() == 10
    assert {(r["field"], r["num"]): r["reason"] for r in proved.collect() if r["reason"]} == {("height", 5.0): "number_not_in_quote", ("width", 4.0): "text_changed", ("gears", 5.0): "number_not_in_quote", ("lamps", None): "text_changed"}
    assert sorted(tuple(r) for r in audit.failures_by_field(proved).collect()) == [("gears", "number_not_in_quote", 1), ("height", "number_not_in_quote", 1), ("lamps", "text_changed", 1), ("width", "text_changed", 1)]
    fields = ["doors", "weight", "height", "width", "seats", "gears", "axles", "lamps", "nothing"]
    wanted = spark.createDataFrame([(1, f) for f in [*fields, "doors"]], "entity int, field string")
    truth = spark.createDataFrame([(1, "doors", 4.0), (1, "weight", 1900.0), (1, "seats", 4.0), (1, "gears", 4.0)], "entity int, field string, num double")
    out = audit.audited(wanted, proved, truth)
    assert {r["field"]: r["result"] for r in out.collect()} == {
        "doors": "correct", "weight": "truth_lacking_or_different", "height": "no_proof", "width": "no_proof", "seats": "not_verified", "gears": "conflict", "axles": "conflict", "lamps": "unknown", "nothing": "unknown"}
    assert audit.audit_summary(out, 0.1).first().asDict() == {"entity": 1, "wanted": 9, "correct": 1, "conflicts": 2, "supported": 2, "matches": 2, "correct_share": 0.1111, "met": True}
    assert {r["result"] for r in audit.audited(wanted, proved.limit(0), truth.limit(0)).collect()} == {"unknown"}


def test_settled_rate(spark):
    wanted = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None)], "k string, field string")
    found = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "x")], "k string, field string")
    assert sorted(tuple(r) for r in audit.settled_rate(wanted, found, ["k"]).collect()) == [("a", 2, 1, 0.5), ("b", 0, 0, None)]


def test_worst_first(spark):
    rows = spark.createDataFrame([("z", "OK"), ("b", "INSUFFICIENT"), ("a", "ODD"), ("c", "REVIEW"), ("a", "REVIEW"), ("n", None)], "label string, status string")
    assert [r["label"] for r in quality.worst_first(rows, "label").collect()] == ["b", "a", "c", "z", "a", "n"]


def test_fit_changes(spark):
    side = lambda rows: spark.createDataFrame(rows, "home int, dimension string, h double, c double")
    profile = spark.createDataFrame([("value", 35.0)], "dimension string, weight double")
    got = score.fit_changes(side([(1, "value", 5.0, 4.0), (1, "body", 5.0, 5.0), (1, "gone", 1.0, 1.0), (2, "odd", 1.0, 2.0)]), side([(1, "value", 5.0, 6.0), (1, "body", 5.0, 5.0), (1, "new", 1.0, 1.0), (2, "odd", 3.0, 2.0)]), profile, ["home"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "value", 35.0, 5.0, 4.0, 5.0, 6.0), (2, "odd", 0.0, 1.0, 2.0, 3.0, 2.0)]
