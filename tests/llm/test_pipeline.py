import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert docs.count() >= 0.98 * before
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "words of a text", "en", None, 3), (1, None, "en", "a", 0), (3, "words of a text", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns
