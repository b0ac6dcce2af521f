"""The pipeline's stages one after another on the smallest tables."""

import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", __import__("pyspark").sql.functions.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns, name
        seen[name] = docs.count()
    assert seen["toxicity"] < 200 and seen["SimHash near-dedup"] < seen["line dedup"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_take_odd_and_empty_documents(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        assert stage(spark, odd, sf).count() > 0, name
