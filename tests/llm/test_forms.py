"""Filter interactions, chat formatting, fill in the middle."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import chat, filter_audit, fim

LABELS = "doc_id bigint, quality int, toxic int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- filter interactions
def fails(rows):
    """{A..E} failed by each row of (doc_id, text)."""
    out = []
    for i, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows)}
        out.append({k for k, v in f.items() if v})
    return out


def audited(docs, labels):
    """The audit by applying the filters one by one, in every order."""
    failed = fails([(r["doc_id"], r["text"]) for r in docs])
    good = [any(q == 1 for i, q, _ in labels if i == r["doc_id"] and i is not None) for r in docs]
    toxic = [any(x == 1 for i, _, x in labels if i == r["doc_id"] and i is not None) for r in docs]
    part = [r["lang"] or "" for r in docs]
    out, taken = {}, {}
    for p in set(part):
        for order in itertools.permutations("ABCDE"):
            alive = [k for k in range(len(docs)) if part[k] == p]
            start = list(alive)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in failed[k]]
                alive = [k for k in alive if f not in failed[k]]
                failing = [k for k in start if f in failed[k]]
                taken[p, f] = taken.get((p, f), 0) + len(gone)
                out[p, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), sum(failed[k] == {f} for k in start), sum(good[k] for k in gone), sum(toxic[k] for k in gone)]
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def seen(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (10, 0, None)]
    got = filter_audit.audit(odd.withColumn("part", F.lit("x")).withColumn("A", F.lit(1)), spark.createDataFrame(labels, LABELS).withColumn("id", F.lit(1)))
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")
    want = audited(odd.collect(), labels)
    assert seen(got) == want and len(want) == 600 * 5


def test_audit_of_mixed_failures(spark, monkeypatch):
    monkeypatch.setattr("factloom.llm.common.COMMON_RECORDS", 5)
    r = random.Random(5)
    pool = []
    for _ in range(24):
        w = [f"w{i}" for i in range(r.choice([20, 130]))]
        w = [r.choice(w[:40]) for _ in w] if r.random() < 0.4 else w
        w = [x.upper() for x in w] if r.random() < 0.3 else w
        pool.append(" ".join(w) + r.choice(["", "", " #"]))
    rows = [(i, pool[0] if r.random() < 0.4 else r.choice(pool), r.choice(["en", "de", None]), None, None) for i in range(150)]
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 150, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert seen(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == audited(docs.collect(), labels)


def test_audit_of_nothing(spark, nothing):
    assert filter_audit.audit(nothing, spark.createDataFrame([], LABELS)).count() == 0


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], "doc_id int, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS), filters={"Z": lambda text, w: text == "a"}, repeated="R")
    assert seen(got) == {("x", "ZR", 1): (1, 2, 0, 1, 0, 0, 3), ("x", "ZR", 2): (1, 0, 1, 0, 0, 0, 1), ("x", "RZ", 1): (2, 1, 0, 0, 0, 0, 1), ("x", "RZ", 2): (1, 1, 1, 1, 0, 0, 3)}


# -- chat
TEXTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "<", "[", "/", "s>", "INST]", "é", "\n", " "])).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]) | TEXTS, TEXTS), max_size=5))
def test_turns_read_back(turns):
    g = chat.grammar(chat.Template())
    written = [g.written(*t) for t in turns]
    whole = "".join(w[0] for w in written)
    again = list(g.turns(whole))
    assert [(role, text) for role, text, _, _ in again] == turns
    at = 0
    for (out, start, length), (_, text), (_, _, a, b) in zip(written, turns, again, strict=True):
        assert (a, b) == (at + start, at + start + length) and g.plain(whole[a:b]) == text
        assert not g.any.search(whole[a:b])  # no text holds a control string
        at += len(out)


def test_only_conflicts_are_escaped():
    g = chat.grammar(chat.Template())
    assert g.written("user", r"a \ b <x> [y]")[0] == r"[INST]a \ b <x> [y][/INST]"
    assert g.written("user", "a [/INST] b")[0] == r"[INST]a [\/INST] b[/INST]"
    assert g.written("user", r"a [\/INST] b")[0] == r"[INST]a [\\/INST] b[/INST]"
    assert g.written("tool", "4")[0] == "[ROLE]tool[TEXT]4[/ROLE]"


@pytest.mark.parametrize("text", ["x", "[INST]a", "[INST]a</s>", "[/INST]", "[INST]a[/INST]x", "[INST]a[INST]b[/INST]", "[ROLE]a[/ROLE]", "[ROLE]user[TEXT]a[/ROLE]", "[TEXT]"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat.Malformed):
        list(chat.grammar(chat.Template()).turns(text))


@pytest.mark.parametrize("marks", [("<a>", "<a>"), ("<a>", "><"), ("<a>", "<a>b"), ("a", "b"), ("aba", "cc"), ("<b<a>>", "<a>")])
def test_ambiguous_templates_are_refused(marks):
    with pytest.raises(ValueError, match="overlap"):
        chat.Template(marks=(("user", *marks),)).control()


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROWS", 3)
    rows = [
        (1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, None, ""), (2, 0, "tool [TEXT]", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 3, "assistant", "é"), (None, 4, "user", "é<s>"),
        *[(3, i, "assistant", "long " * 20_000) for i in range(5)],
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    df = df.withColumns({"id": F.lit(0), "segment": F.lit("s"), "key": F.lit(1)})
    segments = chat.render(df)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert set(got) == {1, 2, 3, None}
    for key, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == key))
        loss = [text for _, role, text in turns if role == "assistant"]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, loss)), sha("".join(loss)))
    parts = segments.collect()
    assert got[1]["formatted_chars"] == sum(len(r["segment"]) for r in parts if r["conv_id"] == 1)
    assert {r["segment"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] for r in parts if r["loss_start"] is not None} == {r"b<\/s>", "x", "é", "long " * 20_000}
    assert all((r["role"] == "assistant") == (r["loss_start"] is not None) for r in parts)
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_chats_of_another_template(spark):
    template = chat.Template(marks=(("user", "<|u|>", "<|/u|>"), ("model", "<|m|>", "<|eot|>")), also=("<|bos|>",), learned=("model",))
    df = spark.createDataFrame([("c", 0, "user", "<|bos|>hi"), ("c", 1, "model", "yo<|eot|>")], "conv_id string, turn int, role string, text string")
    segments = chat.render(df, template)
    assert "".join(r["segment"] for r in segments.orderBy("turn").collect()) == r"<|u|><\|bos|>hi<|/u|><|m|>yo<\|eot|><|eot|>"
    assert chat.read_back(segments, template).first()["loss_sha256"] == sha("yo<|eot|>")


# -- fill in the middle
PARTS = re.compile("[A-Za-z]+|[^A-Za-z]")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ é\n\r中𝒳1<>") | st.characters(exclude_categories=["Cs"]), max_size=60), st.integers(1, 9))
def test_token_ends(text, piece):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fim, "PIECE", piece)
        assert fim.token_ends(text).tolist() == [x.end() for x in PARTS.finditer(text)]


def cut(i, text):
    """(n, form, prefix, middle, output) with plain lists of tokens."""
    text = text or ""
    w = PARTS.findall(text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, monkeypatch):
    monkeypatch.setattr(fim, "ROWS", 7)
    more = [(i, t, None, None, None) for i, t in enumerate(["x<P>y", "<", "<P", "S>", "a" * 200_000 + " b", "𝒳é\n" * 50, *(f"word {i}, other {i}!" for i in range(60))], 100)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    docs = docs.withColumns({"id": F.lit(1), "h1": F.lit(2), "n": F.lit(3), "form": F.lit("f"), "output": F.lit("o")})
    out = fim.transform(docs)
    got = out.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r["doc_id"], *cut(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()), key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_other_shares(spark, nothing):
    docs = spark.createDataFrame([(f"k{i}", "one two three") for i in range(50)], "name string, body string")
    out = fim.transform(docs, "body", "name", seed=3, plain_percent=0, spm_percent=100).collect()
    assert {r["form"] for r in out} == {"spm"} and len({r["output"] for r in out}) > 5 and {r["n"] for r in out} == {5}
    assert fim.transform(nothing).count() == 0
