"""Every query of this subpackage that has SQL, on the smallest tables; the others run."""

from __future__ import annotations

import pytest
from oracle import connect, same

from factloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, name):
    same(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize(("name", "columns"), [
    ("op2_ngram_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}), ("op6_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    ("op7_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}), ("op10_sentencepiece", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
])
def test_one_row_for_each_document(spark, name, columns):
    df = queries.QUERIES[name](spark, FOLDER)
    assert dict(df.dtypes) == columns
    assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
