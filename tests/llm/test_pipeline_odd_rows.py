import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_on_no_rows(spark, data, odd_documents, no_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_documents, data)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    # Texts that are null, empty or white space pass, and rows without doc_id too; repeated rows go together.
    assert {2, 3, 7} <= {r.doc_id for r in rows} and sum(r.doc_id is None for r in rows) == 2
    assert sum(r.doc_id == 8 for r in rows) in (0, 2)
    gone = {"near_duplicates": {6}, "line_dedup": set(), "decontamination": set(), "sentencepiece": set()}
    if name in gone:
        assert {r.doc_id for r in odd_documents.collect()} - {r.doc_id for r in rows} == gone[name]
    # Own columns keep their values; the last stage alone replaces ids.
    for c in set(odd_documents.columns) - {"doc_id", "text", "n_chars", *(["ids"] if name == "sentencepiece" else [])}:
        assert {r[c] for r in rows} == {r[c] for r in odd_documents.collect()}
    empty = stage(spark, no_documents, data)
    assert empty.columns == odd_documents.columns and empty.count() == 0
