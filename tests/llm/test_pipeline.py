"""The pipeline's stages on awkward tables, and whole on a small one."""

import re

import pytest

import corpus_pipeline

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def done(spark):
    docs, kept = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        from tablefill.llm.common import stored
        docs = stored(stage(spark, docs, SF001))
        kept.append(docs)
    return kept


def test_stages_keep_the_columns_of_documents(spark, done):
    want = spark.read.parquet(f"{SF001}/documents.parquet").schema
    for docs in done[:-1]:
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in want]


def test_decisions_take_effect(spark, done):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in done]
    assert len(docs) > len(ids[0]) > len(ids[1]) > len(ids[2]) == len(ids[3]) == len(ids[4])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & ids[0]) <= 0.2 * len(toxic)
    texts = [docs[i] for i in ids[1]]
    assert len(set(texts)) == len(texts)
    items = [re.sub(r"\s+", " ", r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert not any(x in re.sub(r"\s+", " ", docs[i]) for i in ids[2] for x in items)
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.", r.text) for r in done[3].collect())


def test_run_gives_the_same(spark, done):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).collect())) == sorted(map(tuple, done[-1].collect()))


def test_odd_rows_pass_every_stage(spark, awkward, nothing):
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, SF001).count() == 0
        out = stage(spark, awkward, SF001)
        assert out.count() >= awkward.count() - 1
        if stage is not corpus_pipeline.encode:  # columns whose names operators use for their own stay as they are
            assert out.columns == awkward.columns
            assert [tuple(r)[10:] for r in out.select(awkward.columns).collect()] == [tuple("abcdefghijk")] * out.count()
    assert corpus_pipeline.drop_toxic(spark, nothing, SF001).count() == 0
    out = corpus_pipeline.drop_toxic(spark, awkward, SF001)  # nothing to learn from, or little
    assert out.columns == awkward.columns
    assert {r._toxicity for r in out.collect()} == {"g"} and {r.toxicity for r in out.collect()} == {"h"}
