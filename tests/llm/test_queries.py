import pytest

import corpus_pipeline
from larkspur.llm import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    same(registry.queries()[name](spark, sf), duck.execute(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    table = {"op8": "pages", "op9": "conversations", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    rows = registry.queries()[name](spark, sf).collect()
    key = {"pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}.get(table, "doc_id")
    assert {r[key] for r in rows} == {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = docs.count()
        assert 0 < after <= before
        before = after
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids.count() == before and ids.where("NOT round_trip").count() == 0
