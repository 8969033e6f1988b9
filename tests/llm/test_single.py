"""Revisits, URL rules, language, mixing, exact dedup and SentencePiece."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, langid, mixing, queries, revisit, spm, url_filter

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


# -- revisits
LOG = "record_id bigint, kind string, url string, ts bigint, headers map<string,string>, locator string"


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.org:80/x?b=2&a=1&utm_source=q#f", 10, {"etag": '"1"', "content-type": "text/html", "date": "d1"}, "f1"),
        (2, "response", "https://a.org/x?a=1&b=2", 20, {"etag": '"2"', "last-modified": "m"}, "f2"), (3, "response", "https://a.org/x?a=1&b=2", 20, {"etag": '"3"', "last-modified": "m"}, "f3"),
        (4, "revisit", "https://a.org/x?b=2&a=1", 15, {"etag": 'W/"1"', "date": "d4", "content-type": "no", "content-length": "0"}, None), (5, "revisit", "https://a.org/x?a=1&b=2", 20, {"etag": '"1"'}, None),
        (6, "revisit", "https://a.org/x?a=1&b=2", 30, {"etag": '"2"'}, None), (7, "revisit", "https://a.org/x?a=1&b=2", 31, {"last-modified": "m"}, None), (8, "revisit", "https://a.org/x?a=1&b=2", 9, {}, None),
        (9, "revisit", "https://a.org/x?a=1&b=2", 40, None, None), (10, "revisit", None, 40, None, None), (11, "revisit", "nothing", 1, None, None), (12, "revisit", "https://a.org/x?a=1&b=2", None, None, None), (12, "revisit", "https://a.org/x?a=1&b=2", None, None, None), (13, "warcinfo", None, None, None, None),
    ]
    got = {r["record_id"]: r for r in revisit.resolve(spark.createDataFrame(rows, LOG).withColumn("rank", F.lit(1)).withColumn("part", F.lit(2))).collect()}
    assert {k: (r["outcome"], r["refers_to"]) for k, r in got.items()} == {
        4: ("resolved", 1), 5: ("resolved", 1), 6: ("changed", None), 7: ("resolved", 3), 8: ("no_response", None), 9: ("no_validator", None), 10: ("no_response", None), 11: ("no_response", None), 12: ("no_response", None)}
    assert got[4]["headers"] == {"etag": 'W/"1"', "date": "d4", "content-type": "text/html"} and got[4]["locator"] == "f1" and got[6]["headers"] is None
    assert revisit.resolve(spark.createDataFrame([], LOG)).count() == 0


def test_revisits_of_one_busy_url(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["response", "revisit"]), "http://a/" + r.choice("xxxxy"), r.randrange(200), {"etag": r.choice("ab")}, str(i)) for i in range(600)]
    got = {x["record_id"]: (x["outcome"], x["refers_to"]) for x in revisit.resolve(spark.createDataFrame(rows, LOG).repartition(7)).collect()}
    for i, kind, url, ts, h, _ in rows:
        if kind == "revisit":
            full = max(((t, j, g) for j, k, u, t, g, _ in rows if k == "response" and u == url and t < ts), key=lambda x: x[:2], default=None)
            assert got[i] == (("no_response", None) if full is None else ("resolved", full[1]) if full[2] == h else ("changed", None))


# -- url rules
def test_url_rules(spark, monkeypatch):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "https://WWW.Example.NET/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"), "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://net": ("net", "", None, "allow"), "http://a.org/fr/b": ("a.org", "/fr/b", "org/fr/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"), "http://a.net?/x": ("a.net", "", None, "allow"), "http://a.net#/": ("a.net", "", None, "allow"), "x://y://z.net/": ("y:", "//z.net/", None, "allow"), "http://.net/": (".net", "/", "net/", "block"), "http://example.net/e": ("example.net", "/e", "net/", "block"),
    }
    rules = spark.createDataFrame(queries.RULES + [(None, "/", "block"), ("", "/", "block"), ("net", None, "block")], "host string, path string, action string")
    df = spark.createDataFrame([(u, i) for i, u in enumerate([*cases, *cases])], "url string, e int").withColumn("rule", F.lit("old")).withColumn("prefix", F.lit("p")).withColumn("h", F.lit(1))
    for most in (100_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = url_filter.judge(df, rules).collect()
        assert len(got) == 2 * len(cases) and all((r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]] for r in got)
    assert [r["verdict"] for r in url_filter.judge(df.limit(1), rules.limit(0)).collect()] == ["allow"] and url_filter.judge(df.limit(0), rules).count() == 0


def test_rule_precedence(spark):
    rules = spark.createDataFrame([("b.c", "/", "block"), ("a.b.c", "/", "allow"), ("c", "/long/path/", "block"), ("d", "/", "allow"), ("d", "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([("x://a.b.c/long/path/1",), ("x://a.b.c/",), ("x://z.b.c/",), ("x://d/",)], "url string")
    assert [r["verdict"] for r in url_filter.judge(pages, rules).orderBy("url").collect()] == ["allow", "block", "block", "block"]


# -- language
def test_held_out_languages_are_recognised(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.op6_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_documents(spark, odd, nothing):
    model = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), per_lang=30, landmarks=64)
    got = langid.identify(odd, model, passing=["lang", "h"]).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6)) and all(r["lang_pred"] in model.labels for r in got if r["doc_id"] in (1, 10, 11))
    assert {r["h"] for r in got} == {odd.first()["h"]}
    assert langid.fit(nothing) is None and [r["lang_pred"] for r in langid.identify(odd, None).collect()] == ["und"] * len(got)
    assert langid.identify(nothing, model).count() == 0 and langid.fit(odd, landmarks=3) is not None


def test_training_never_sees_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.fit(d, per_lang=30, landmarks=32) for d in (docs, other))
    assert a.labels == b.labels and (a.weights == b.weights).all()


def test_a_language_of_few_rows_has_landmarks():
    r = random.Random(1)
    some = lambda letters: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(30))
    labels = ["aa"] * 300 + ["bb"] * 300 + ["cc"] * 10
    letters = {"aa": "abcdefgh", "bb": "stuvwxyz", "cc": "абвгдежз"}
    model = langid.Classifier([some(letters[label]).encode() for label in labels], labels, 256, 1.0)
    for label in letters:
        text = some(letters[label]).encode()
        scores = model.scores(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert model.labels[int(scores.argmax())] == label
    assert len(langid.shares(labels, 256)) == 256 and langid.shares(["x", "x", "y", "x"], 1) == [0, 2]


# -- mixing
def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("name", ["odd", "copies", "skewed"])
def test_mixing(spark, request, name):
    if name == "skewed":
        df = spark.createDataFrame([(i, "w " * (i % 17), "en", "hot" if i % 3 else f"s{i % 20}", 0) for i in range(900)] + [(1000, None, None, "empty", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    else:
        df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text", "source").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = targets_by_hand(sizes)
    mixed = mixing.mix(df).join(df.select(F.xxhash64("doc_id", "text").alias("row_key"), "source").distinct(), "row_key")
    got = mixed.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixed.collect()))
    taken: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_mixed_rows(spark, odd, nothing):
    took = {r["row_key"] for r in mixing.mix(odd).collect()}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(nothing).count() == 0 == mixing.mix(nothing).count()
    times = {r["k"]: r["count"] for r in out.groupBy(F.xxhash64("doc_id", "text").alias("k")).count().collect()}
    want: dict = {}
    for r in mixing.mix(odd).collect():
        want[r["row_key"]] = want.get(r["row_key"], 0) + (-(-r["taken"] // r["size"]) if r["size"] else 0)
    assert all(times.get(k, 0) == n for k, n in want.items()) and set(times) <= set(took)


def test_repeated_rows_keep_to_the_budget(spark, monkeypatch):
    """Rows equal in id and text are dealt one by one, whatever task they lie in, and beside others of their source."""
    schema = "doc_id bigint, text string, source string"
    same, other = (1, "w " * 100, "b"), [(i, "v " * 100, "a") for i in range(2, 8)]
    rows = [same] * 10 + other
    for parts in (1, 4):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        target = next(r["target"] for r in mixing.mix(df).collect() if r["doc_id"] == 1)
        got = [r["doc_id"] for r in mixing.mixed(df).collect()]
        assert target == 1600 * 2 / 7 and got.count(1) == -(-int(target) // 100) < 10 and len(got) - got.count(1) == -(-int(1600 - target) // 100)
    # A hot repeated row among many tasks: every copy has a number of its own, each once.
    df = spark.createDataFrame([same] * 300 + [(None, "x y", None)] * 40 + other, schema).repartition(7)
    rows = df.select(F.monotonically_increasing_id().alias("_at"), "*")
    copies = mixing._described(rows, F.col("doc_id"), F.col("text"), F.col("source")).groupBy("_id", "source").agg(F.sort_array(F.collect_list("copy")).alias("c")).collect()
    assert sorted(len(r["c"]) for r in copies) == [1] * 6 + [40, 300] and all(r["c"] == list(range(len(r["c"]))) for r in copies)


# -- exact dedup
def kept_by_hand(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups: dict = {}
    for (d, t), s in zip(rows, norm, strict=True):
        groups.setdefault(s, []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for (d, _), s in zip(rows, norm, strict=True):
        keep = min(groups[s])[3]
        out.append((d, keep, len(groups[s]), d == keep, hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("files_per_batch", [None, 1])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, odd, copies, tmp_path, files_per_batch, digest):
    df = odd.select("doc_id", "text").union(copies.limit(20).select("doc_id", (F.concat(F.lit(" "), F.col("text"))).alias("text"))).union(copies.limit(20).select(F.col("doc_id") + 1000, "text"))
    df.withColumn("digest", F.lit("x")).withColumn("place", F.lit("y")).repartition(4).write.parquet(str(tmp_path / "t"))
    rows = [tuple(r) for r in df.collect()]
    table = spark.read.parquet(str(tmp_path / "t"))
    got = exact_dedup.deduplicate(spark, str(tmp_path / "t"), table.schema, digest=digest, files_per_batch=files_per_batch)
    found = sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert found == kept_by_hand(rows) and all(r["keep_place"]["file"].startswith("file:") for r in got.collect())
    if digest is exact_dedup.sha256:  # the locator leads to the row that stays
        at = {(r["file"], r["row"]): r["doc_id"] for r in table.select("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).collect()}
        assert all(at[tuple(r["keep_place"])] == r["keep_id"] for r in got.collect())


def test_exact_dedup_of_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "t"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "t"), nothing.schema).count() == 0


def test_language_scores_are_those_of_the_plain_kernel(spark):
    """Sets of byte runs, their kernel and the ridge regression written out, against the operator's products."""
    r = random.Random(2)
    alphabet = {"aa": "abcde ", "bb": "defgh ", "cc": "xyzé "}
    texts = [(i, "".join(r.choices(alphabet[lang], k=40)), lang) for i in range(90) for lang in [r.choice(sorted(alphabet))]]
    model = langid.Classifier([t.encode() for _, t, _ in texts], [x for _, _, x in texts], 20, 1.0)

    def runs(text):
        b = bytes(x if chr(x).isalpha() or x >= 128 else 32 for x in text.lower().encode())
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    sets = [runs(t) for _, t, _ in texts]
    every = set().union(*sets)
    k = lambda x, y: len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1))
    marks = [sets[i] for i in langid.shares([x for _, _, x in texts], 20)]
    kmm = np.array([[k(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(kmm)
    half = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    feature = lambda s: np.r_[np.array([k(s, y) for y in marks]) @ half, 1]
    z = np.array([feature(s) for s in sets])
    y = np.array([[1.0 if x == label else -1.0 for label in sorted(alphabet)] for _, _, x in texts])
    w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ y)
    probe = ["abc de", "fgh dd q", "xyz é é", "", "dead beef", "q" * 3000 + " abc"]
    got = np.array([model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in probe])
    assert np.allclose(got, [feature(runs(t) & every) @ w for t in probe], atol=1e-3)


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(i, "kurz und gut " * 3, "de") for i in range(30)] + [(100 + i, "longo texto aqui " * 8000, "pt") for i in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.labels == ["de", "pt"]


# -- mixing, row by row
def test_mix_cuts_in_hash_order(spark, monkeypatch):
    """Every row against a plain loop over the rows of a source in the order of their keys; with many ranges too."""
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randrange(9)), r.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    key = {x["doc_id"]: x["k"] % 2**64 for x in df.select("doc_id", F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(7)).alias("k")).collect()}
    for rows_of_range in (262_144, 1):
        monkeypatch.setattr(mixing, "ROWS", rows_of_range)
        got = {x["doc_id"]: x for x in mixing.mix(df).collect()}
        for source in ("a", "b", None):
            mine = sorted((i for i, _, s in rows if s == source), key=lambda i: key[i])
            size = {i: len(t.split()) for i, t, s in rows if s == source}
            target = got[mine[0]]["target"]
            whole, left = divmod(math.floor(target), sum(size.values()))
            for i in mine:
                part = min(size[i], left)
                left -= part
                assert (got[i]["size"], got[i]["taken"]) == (size[i], whole * size[i] + part)


# -- SentencePiece
def test_encoding_of_one_long_part(library):
    r = random.Random(6)
    t = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))
    assert spm.model(queries.model_path()).encode(t)[0] == ",".join(map(str, library.encode(t)))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


ODD = ["", " ", "  ", "\n", "a  b", "   lead", "trail   ", "▁", "a▁b", "\t\r\n", "日本語のテキスト", "naïve café", "🙂🙃 emoji", "\u200b\u00a0", "<s></s><unk><0x41>", "don't", "x" * 3000, "ab" * 1500, "\x00\x01", "e\u0301", "ﬁ", "1234567890" * 20, "…—“”", "\ud7ff\ue000", "a\u2581\u2581 b"]


def test_encoding_is_the_library_s(library):
    m = spm.model(queries.model_path())
    r = random.Random(5)
    texts = ODD + ["".join(r.choices("abc theing ▁\n.,é日🙂0", k=r.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t)
        got = m.encode(t)
        assert got == (",".join(map(str, ids)), library.decode(ids)), repr(t)


def test_encoding_of_odd_documents(spark, library, odd, nothing):
    got = spm.encode_decode(odd, queries.model_path()).collect()
    want = {}
    for r in odd.select("doc_id", "text").collect():
        want[r["doc_id"]] = library.encode(r["text"] or "")
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            ids = want[r["doc_id"]]
            assert r["n_tokens"] == len(ids) and r["ids"] == ",".join(map(str, ids)) and r["decoded"] == library.decode(ids)
            assert r["ids_sha256"] == hashlib.sha256(r["ids"].encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert spm.encode_decode(nothing, queries.model_path()).count() == 0


def test_caches_forget(library, monkeypatch):
    monkeypatch.setattr(spm, "PARTS", 3)
    monkeypatch.setattr(spm, "PAIRS", 2)
    m = spm.Model(queries.model_path())
    for t in ["the quick brown fox jumps", "over the lazy dog", "the fox"] * 3:
        assert m.encode(t)[0] == ",".join(map(str, library.encode(t)))
        assert len(m.parts) <= 4 and len(m.pairs) <= 4
