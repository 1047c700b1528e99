"""The mixed sequence survives the files between the stages."""

import corpus_pipeline
from quillon.llm import _util as U
from quillon.llm import pfair_mix


def test_last_stage_returns_the_mixed_sequence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").where("doc_id < 120")
    docs = U.stored(docs, "sequence-test")
    mixed = U.stored(corpus_pipeline.mix_sources(spark, docs, sf), "sequence-test")
    assert len(mixed.inputFiles()) > 1
    got = corpus_pipeline.pieces(spark, mixed, sf).select("position", "doc_id").orderBy("position").collect()
    want = [r.doc_id for r in pfair_mix.mixed(docs).orderBy("slot", "place").collect()]
    assert [tuple(r) for r in got] == list(enumerate(want))
    loose = spark.createDataFrame([(i,) for i in (5, 3, 9)], "doc_id long").coalesce(1)
    assert [r.doc_id for r in pfair_mix.with_position(loose).orderBy("position").collect()] == [5, 3, 9]
