"""The pipeline's stages against plain loops."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from test_joins import near, removed_by_hand

from factloom.llm import langid, queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], FOLDER)
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == COLUMNS for d in seen[:-1])
    rows = [[tuple(r) for r in d.collect()] for d in seen]
    judged = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    kept = {d for d, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    assert {r[0] for r in rows[1]} == kept and len(kept) > 0.9 * len(rows[0])
    gone = removed_by_hand([r[:2] for r in rows[1]])
    want = {}
    for i, r in enumerate(rows[1]):
        left = [x for p, x in enumerate(r[1].split("\n")) if (i, p) not in gone]
        if left:
            want[r[0]] = "\n".join(left)
    assert {r[0]: r[1] for r in rows[2]} == want and all(r[4] == len(r[1]) for r in rows[2])
    assert {r[0] for r in rows[3]} == {d for d, n, c in near([r[:2] for r in rows[2]]) if d == c or n == 0}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    texts = {r[0]: r[1] for r in rows[4]}
    assert set(texts) <= {r[0] for r in rows[3]} and len(rows[4]) == len(rows[5])
    for r in seen[5].collect():
        ids = ",".join(map(str, library.encode(texts[r["doc_id"]])))
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 50


def test_stages_of_odd_documents(spark, odd, nothing):
    """Nulls, empty texts, repeated rows and clashing columns pass every stage; so does an empty table."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, odd.select(*names), nothing):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            rows = out.collect()
            if i < len(corpus_pipeline.STAGES) - 1:
                assert set(names) <= set(out.columns)
                assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
            if docs is nothing:
                assert not rows
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, odd, FOLDER).collect()]
    assert kept.count(1) == 1 and 3 not in kept and {4, 5, 6} <= set(kept) and kept.count(None) == 2
