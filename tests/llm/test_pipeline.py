"""The stages one after the other on the smallest tables, and each one's promise on its own input."""

import os

import pytest

import corpus_pipeline
from plaintide.llm import byte_bpe, queries, scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.written(stage(spark, docs, SF), name)
        if name != "encode":
            assert docs.columns == columns
            assert docs.join(first, columns, "left_anti").count() == 0
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            bad = docs.join(labels, "doc_id").filter("quality = 0").count()
            good = labels.join(first, "doc_id").filter("quality = 1").join(docs, "doc_id", "left_anti").count()
            assert bad <= 2 and good <= 2
        if name == "exact_dedup":
            assert docs.selectExpr("count(*) = count(DISTINCT translate(text, ' \\t\\n', ''))").first()[0]
        if name == "near_dedup":
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
        if name == "mixing":
            assert before.join(docs, "doc_id", "left_anti").count() == 0
        if name == "encode":
            texts = {r.doc_id: r.text for r in before.collect()}
            path = queries.tokenizer_file(queries.BYTE_BPE)
            assert all(byte_bpe.decode(r.ids, path) == texts[r.doc_id] for r in docs.collect())
            assert docs.count() == before.count()


def test_a_run_leaves_its_result_alone(spark):
    def count(spark, docs, sf_dir):
        return docs.join(scratch.written(docs.groupBy("source").count(), "on-the-way"), "source")

    kept = scratch.written(spark.range(3), "kept")
    folder = scratch.shared_folder(spark)
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = scratch.written_alone(spark, lambda: count(spark, docs, SF), "first")
    rows = first.count()
    second = scratch.written_alone(spark, lambda: first.select("doc_id"), "second")
    scratch.discard(first)
    scratch.discard(docs)
    assert second.count() == rows == docs.count() and kept.count() == 3
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["second"]
    with pytest.raises(ZeroDivisionError):
        scratch.written_alone(spark, lambda: count(spark, docs, SF) if not 1 / 0 else docs, "broken")


def test_every_query_has_a_row_per_row(spark):
    for name, query in queries.queries().items():
        table = "embeddings" if name.startswith(("op1_", "op12_")) else "documents"
        if name.startswith("op13_"):  # a row per word
            continue
        per_row = 32 if name.startswith("op12_") else 1
        assert query(spark, SF).count() == per_row * spark.read.parquet(f"{SF}/{table}.parquet").count(), name
    assert set(queries.oracle_sql()) <= set(queries.queries())
