"""n-gram join, line dedup, substring dedup and embeddings against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import embed, lines, ngram_join, substring

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return SEP.findall(text)


def classes(ids, linked):
    root = {i: i for i in range(len(ids))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(len(ids))]


def shingles(text, n=5):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(rows, n=5, share=75):
    sets = [shingles(t, n) for _, t in rows]
    link = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])
    cls = classes([r[0] for r in rows], link)
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, cls, strict=True)), key=str)


def test_near_duplicates(spark, copies, odd, nothing, monkeypatch):
    for tile in (64, 4):  # small tiles take the way of large blocks
        monkeypatch.setattr(ngram_join, "TILE", tile)
        for df in (copies, odd):
            rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
            got = [tuple(r) for r in ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()]
            assert sorted(got, key=str) == near(rows)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_a_chain_of_shared_ngrams_costs_in_proportion(spark, monkeypatch):
    """Neighbours share a rare part, so all documents are one block, yet hardly any link: rows that meet grow with them."""
    r = random.Random(8)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    met, linked = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda tiles, *a: (met.append(tiles.count()), linked(tiles, *a))[1])
    costs = []
    for n in (100, 400):
        part = [" ".join(f"p{i}x{r.randrange(10**6)}" for _ in range(10)) for i in range(n + 1)]
        tail = [" ".join(f"t{r.randrange(10**6)}" for _ in range(2)) for _ in range(n)]
        rows = [(i, f"{part[i]} {tail[i]} {part[i + 1]}") for i in range(n)] + [(n, f"{part[0]} {tail[0]} {part[1]} more")]
        met.clear()
        got = [tuple(x) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n=3, share=45).collect()]
        assert sorted(got, key=str) == near(rows, 3, 45)
        costs.append(sum(met))
    assert costs[1] < 5 * costs[0]


def test_t_occurrence_finds_what_a_scan_finds():
    import numpy as np

    r = random.Random(2)
    sets = [set(r.sample(range(50), r.randrange(1, 30))) for _ in range(60)]
    sets += [set(list(s)[1:]) | {99} for s in sets[:20] if len(s) > 4]
    grams = [np.array(sorted(s), np.uint64) for s in sets]
    got = set(ngram_join.t_occurrence(np.array([len(s) for s in sets]), grams, 75, mu=1.0))
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}


def test_one_of_each_keeps_clean_rows(odd):
    rows = near([tuple(r) for r in odd.select("doc_id", "text").collect()])
    want = sorted((d for d, n, c in rows if n == 0 or d is None or d == c), key=str)
    assert sorted((r["doc_id"] for r in ngram_join.one_of_each(odd).collect()), key=str) == want and 0 < len(want) < len(rows)


def removed_by_hand(rows, share=90):
    """(position in rows, line) of lines that go; rows sorted by id, nulls last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, gone = [], set()
    for i in order:
        own = []
        for p, line in enumerate(rows[i][1].split("\n") if rows[i][1] is not None else []):
            s = frozenset(words(line))
            if s and any(100 * len(s & t) >= share * len(s | t) for t in seen + own):
                gone.add((i, p))
            if s:
                own.append(s)
        seen += own
    return gone


def test_lines(spark, copies, nothing):
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    gone = removed_by_hand(rows)
    want = {r[0]: (len(r[1].split("\n")), ",".join(str(p) for p in sorted(p for j, p in gone if j == i))) for i, r in enumerate(rows)}
    assert len(gone) > 30
    assert {r["doc_id"]: (r["n_lines"], r["removed"]) for r in lines.line_report(copies).collect()} == want
    kept = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(copies).collect()}
    for i, (d, t) in enumerate(rows):
        left = [x for p, x in enumerate(t.split("\n")) if (i, p) not in gone]
        assert kept.get(d) == ("\n".join(left) if left else None)
    assert lines.line_report(nothing).count() == 0 and lines.without_repeated_lines(nothing).count() == 0


def test_lines_meet_whole_lists_when_the_quick_partner_falls_through(copies, monkeypatch):
    """With the parity filter open, quick partners are often wrong; the result stays the same."""
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    monkeypatch.setattr(lines, "_possible", lambda share: lines.F.lit(True))
    got = {(r["doc_id"], p) for r in lines.line_report(copies).collect() for p in r["removed"].split(",") if p}
    assert got == {(rows[i][0], str(p)) for i, p in removed_by_hand(rows)}


def test_lines_meet_whole_lists_when_the_quick_partner_is_met_in_another_list_too(spark):
    """z meets x alone under a and in the ordinary way under b; x falls through, and only a's list holds z's partner w."""
    names = [f"c{i}" for i in range(40)]
    place = {r["w"]: r["h"] & 63 for r in spark.createDataFrame([(n,) for n in names], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    c, other = next((m, n) for i, m in enumerate(names) for n in names[:i] if place[m] == place[n])
    common = [f"s{i}" for i in range(16)]
    x, w, z = ["a", "b", other, "f", *common], ["a", c, "e", "v", *common], ["a", "b", c, "e", *common]
    counts = {"b": 10, c: 20, other: 20} | {t: 60 for t in ["e", "f", "v", *common]}
    rows = [(1, " ".join(x)), (2, " ".join(w)), (3, " ".join(z))] + [(10 + i, " ".join([t] * n)) for i, (t, n) in enumerate(counts.items())]
    got = {(r["doc_id"], p) for r in lines.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() for p in r["removed"].split(",") if p}
    assert got == {(rows[i][0], str(p)) for i, p in removed_by_hand(rows)} == {(3, "0")}


def test_lines_that_share_all_but_a_rare_word(spark):
    """One list holds them all, under sizes and places of which few fit each other."""
    r = random.Random(11)
    tail = list("abcdefghjkm")
    rows = [(i, " ".join([f"u{i}" if r.random() < 0.8 else f"u{i // 3}", *tail[: r.choice([8, 9, 9, 10, 11])], *(["z"] if r.random() < 0.3 else [])])) for i in range(220)]
    rows += [(1000 + i, " ".join(tail[:k])) for i, k in enumerate((9, 10, 11))]
    got = {(x["doc_id"], p) for x in lines.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() for p in x["removed"].split(",") if p}
    assert got == {(rows[i][0], str(p)) for i, p in removed_by_hand(rows)} and len(got) >= 15


def test_lines_of_odd_documents(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").distinct().collect()]
    gone = removed_by_hand(rows)
    want = {r: ",".join(str(p) for p in sorted(p for j, p in gone if j == i)) for i, r in enumerate(rows)}
    by_id = {(d, t is None): w for (d, t), w in want.items()}
    report = lines.line_report(odd).collect()
    assert len(report) == odd.count()
    assert all(r["removed"] == by_id[r["doc_id"], r["n_lines"] == 0] for r in report)
    got = {r["doc_id"]: r for r in report}
    assert got[4]["n_lines"] == 0 and got[5]["n_lines"] == 1 and got[6]["n_lines"] == 2 and got[5]["removed"] == got[6]["removed"] == got[13]["removed"] == ""
    kept = lines.without_repeated_lines(odd)
    assert kept.columns == odd.columns and {4, 5, 6, 12, 13} <= {r["doc_id"] for r in kept.collect()}


def cut_by_hand(texts, window):
    w = [words(t) for t in texts]
    seen = {}
    for ws in w:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for ws in w:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append([x for x, g in zip(ws, gone, strict=True) if not g])
    return out


def test_repeats(spark, odd, copies, nothing):
    for df, window, seed in ((odd, 35, 12), (copies, 9, 4), (copies, 5, 5), (copies, 3, 1)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = sorted((str(d), k) for (d, _), k in zip(rows, cut_by_hand([t for _, t in rows], window), strict=True))
        got = sorted((str(r["doc_id"]), r["kept"]) for r in substring.remove_repeats(df, window=window, seed=seed).collect())
        assert got == want
    assert substring.remove_repeats(nothing).count() == 0


def test_repeats_of_frequent_seeds_and_of_equal_hashes(spark, copies, monkeypatch):
    """Lists of two occurrences; then all seeds in one list, and all windows under one number: words decide."""
    rows = [(r["doc_id"], r["text"]) for r in copies.select("doc_id", "text").collect()]
    want = sorted((str(d), k) for (d, _), k in zip(rows, cut_by_hand([t for _, t in rows], 6), strict=True))
    for name, value in (("LIST", 2), ("hash_words", lambda words: 1), ("mix", lambda h: h * 0 + 5)):
        monkeypatch.setattr(substring, name, value)
        assert sorted((str(r["doc_id"]), r["kept"]) for r in substring.remove_repeats(copies, window=6, seed=3).collect()) == want


def test_maximal_repeats(spark):
    """A passage of three documents, longer than seeds' windows reach, is one repeat a place, with a partner and its place."""
    passage = " ".join(f"p{i}" for i in range(200))
    texts = ["a0 a1 " + passage + " a2", passage, "b0 " + passage + " b1 " + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    key = {r["k"]: r["doc_id"] for r in df.select("doc_id", substring.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    got = {(key[r["key"]], r["start"], r["end"], key[r["other"]], r["shift"]) for r in substring.repeats(substring.matches(df)).collect()}
    starts = {(0, 2), (1, 0), (2, 1), (2, 202)}
    assert {(d, s) for d, s, e, _, _ in got if e - s == 200} == starts
    assert all((o, s + x) in {(d, p + s - q) for d, p in starts for q in [next(y for e, y in starts if e == k and y <= s < y + 200)]} for k, s, _, o, x in got)


def test_repeat_across_slices(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE", 50)
    r = random.Random(1)
    passage = [f"p{i}" for i in range(55)]
    texts = [[f"a{r.randrange(10**6)}" for _ in range(r.randrange(80))] + (passage if i % 3 == 0 else []) + [f"b{i}"] for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x["doc_id"]: x["kept"] for x in substring.remove_repeats(df).collect()}
    assert got == {i: [w for w in t if not w.startswith("p")] for i, t in enumerate(texts)}


def test_vectors(spark, monkeypatch):
    r = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = []
    for i in range(300):
        if rows and r.random() < 0.6:
            v = [x + r.gauss(0, 0.12) for x in r.choice([x for x in rows if x[1] and len(x[1]) == 8])[1]]
        else:
            v = [r.gauss(0, 1) for _ in range(8)]
        rows.append((i, v, r.choice([0, 0, 0, 1, None])))
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] + [0.0] * 6, 0), (303, [nan] * 8, 0), (304, [inf] + [0.0] * 7, 0), (305, [], 0), (306, [1.0, 1.0], 0), (307, [2.0, 2.0], 0), (308, [1e-30] * 8, 1), (309, [1e30] * 8, 1), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as key", "2 as raw", "3 as vec", "4 as dim").repartition(5)

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is None or la != lb or not ok(a) or not ok(b) or len(a) != len(b):
            return False
        a, b = [x / max(map(abs, a)) for x in a], [x / max(map(abs, b)) for x in b]
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)) >= 0.93

    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    cls = classes([x[0] for x in rows], linked)
    want = sorted((x[0], n, c, x[0] == c) for x, n, c in zip(rows, links, cls, strict=True))
    assert sum(links) > 100
    for side, depth in ((1024, 40), (7, 40), (7, 4)):  # one tile, a deep tree, leaves of several parts
        monkeypatch.setattr(embed, "SIDE", side)
        monkeypatch.setattr(embed, "DEPTH", depth)
        assert sorted(map(tuple, embed.near_vectors(df).collect())) == want
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_far_leaves_never_meet(spark, monkeypatch):
    """Vectors round many centres: the pairs of leaves grow with the leaves, not with their square."""
    monkeypatch.setattr(embed, "SIDE", 32)
    r = random.Random(9)

    def pairs(centres):
        at = [[r.gauss(0, 1) for _ in range(12)] for _ in range(centres)]
        rows = [(i, [x + r.gauss(0, 0.02) for x in at[i % centres]], 0) for i in range(20 * centres)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
        whole = df.select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("vec"), F.lit(1).cast("bigint").alias("copies"), F.size("embedding").alias("dim"))
        fields = ", ".join(f"{c} double" for c in embed._BOX)
        placed = embed.staged(whole.select("key", "label", "dim", "copies", "vec").mapInArrow(embed._place(embed._axes(whole), embed.DEPTH), f"key bigint, label int, dim int, copies bigint, raw binary, code bigint, {fields}"))
        home, met = embed._leaves(placed, math.sqrt(2 - 2 * 0.93))
        return home.select("leaf").distinct().count(), met.count()

    (few, few_pairs), (many, many_pairs) = pairs(16), pairs(64)
    assert many > 2 * few
    assert many_pairs < many * many / 8


def test_report_digest_is_of_kept_words(spark, tmp_path):
    from factloom.llm import queries

    t = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, t), (2, t + " end"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[2]["kept_sha256"] == hashlib.sha256(b"end").hexdigest() and got[1]["n_removed"] == 40 and got[3]["n_words"] == 0


def test_sets_under_many_common_ngrams_meet_once(spark, monkeypatch):
    """Sets that share many n-grams, none a copy: they meet under one list, not under each of those n-grams."""
    nj = ngram_join

    r, shared = random.Random(3), list(range(1, 31))
    grams = [np.unique(np.array(sorted(r.sample(shared, 15)) + [1000 * (k + 1) + j for j in range(40)], np.uint64)) for k in range(40)]
    grams += [np.unique(np.r_[grams[0][:-2], np.array([7], np.uint64)])]
    rows = [(k, len(g), g.tobytes(), 1) for k, g in enumerate(grams)]
    sets = spark.createDataFrame(rows, "key long, n int, grams binary, block long")
    by_token = spark.createDataFrame([(k, int(t)) for k, g in enumerate(grams) for t in g if t < 31], "key long, token long")
    met = []
    linked = nj._linked
    monkeypatch.setattr(nj, "_linked", lambda tiles, *a: met.append(tiles.count()) or linked(tiles, *a))
    got = nj._strays(spark.range(41).select(F.col("id").alias("key")), sets, by_token, 75, 4)
    assert {tuple(sorted(x)) for x in got.collect()} == {(0, 40)}
    assert met[0] <= 2 * len(grams)
