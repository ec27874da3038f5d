"""The registered queries against SQL where there is some, else for shape and held-out quality."""

import pytest
from compare import check, duck

from mailglass.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def engine(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, engine, small, name):
    message, _, _ = check(spark, engine, name, QUERIES[name], ORACLES[name], small)
    assert message is None, message


def test_quality_held_out(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op2_quality"](spark, small).join(labels, "doc_id").filter("held_out").collect()
    assert rows and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_language_held_out(spark, small):
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language"](spark, small).join(truth, "doc_id").filter("held_out").collect()
    assert rows and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95


def test_pipeline_keeps_each_kept_document(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, small).cache()
        assert docs.columns == before.columns, name
        assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text").unionByName(before.select("doc_id", "text")).unionByName(before.select("doc_id", "text")).unionByName(before.select("doc_id", "text"))).isEmpty(), name
    batches = p.pack_batches(spark, docs, small).collect()
    words = sum(len(r.text.split()) for r in docs.collect())
    assert sum(b.n_tokens for b in batches) == words
    assert all(b.bucket * b.n_sequences - b.n_tokens == b.padding >= 0 for b in batches)
