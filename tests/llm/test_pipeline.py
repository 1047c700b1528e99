"""The pipeline's stages in order, each on what its predecessor kept."""

import corpus_pipeline
from quillon.llm import jaccard_join, pii, registry


def test_registry_has_every_operator():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id for r in docs.collect()}
        assert rows.keys() <= before
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in jaccard_join.near_components(docs, 5, 80, 100).collect()}
            assert rows.keys() == set(groups.values())
        if name == "personal_data":
            assert not any(pii.base_spans(r.text) for r in rows.values() if r.text)
        if name in ("personal_data", "mix_sources"):
            assert rows.keys() == before
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    assert last.where("not exact").count() == docs.where("text like '%▁%'").count()
