import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, data)
    assert set(docs.columns) < set(out.columns) and "ids" in out.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
