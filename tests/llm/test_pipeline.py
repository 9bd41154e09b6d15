"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
import pytest

from tastemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    rows = [(r["doc_id"], int(len(r["text"] or "") > 60), 0) for r in docs.collect() if r["doc_id"] is not None]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_keep_the_columns(spark, docs, folder, tmp_path):
    current = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = current
        stage(spark, current, folder).write.parquet(f"{tmp_path}/{i}")
        current = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert current.columns == docs.columns
            assert current.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
        else:
            assert current.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_rejected_and_near_copies_go(spark, folder, docs):
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert kept.where("text is null or text = ''").count() == 0 and 0 < kept.count() < docs.count()
    ids = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    assert 1 in ids and 40 * 3 + 1 + 3 not in ids  # the exact copy of the first text


def test_stripped_text_has_its_length(spark, folder, docs):
    out = corpus_pipeline.substring_dedup(spark, docs, folder)
    assert out.where("text is not null and n_chars <> length(text)").count() == 0
    assert out.count() == docs.count()


def test_empty_table(spark, folder, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_run(spark, root):
    pieces = corpus_pipeline.run(spark, root)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
