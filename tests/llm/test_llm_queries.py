"""Registered queries equal their SQL; the pipeline keeps its contract."""

import pytest

import corpus_pipeline
from compare import connect, difference
from plumbline.llm import oracle, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_query_equals_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, FOLDER), connect(FOLDER), oracle.STATEMENTS[name]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = corpus_pipeline.run(spark, FOLDER)
    assert 0 < left.count() < docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).columns == corpus_pipeline.DOCUMENT_COLUMNS
