"""The stages of the pipeline, each on its predecessor's rows."""

import corpus_pipeline
from groundspark.llm import jaccard_join, quality
from groundspark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    sizes = [len(kept)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= kept
        kept = ids
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_rejects_what_scores_low(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in quality.report(docs, labels).collect()}
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.5}


def test_no_labels_keep_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.report(docs, labels).collect()} == {0.5}
    assert quality.keep_good(docs, labels).count() == docs.count()


def test_one_of_each_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.component_id for r in jaccard_join.report(docs).collect()}
    assert {r.doc_id for r in jaccard_join.keep_first(docs).collect()} == {i for i, c in found.items() if i == c}
