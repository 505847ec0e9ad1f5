import zlib

from hybridkb.llm.toxicity import drop_toxic, score_toxicity

BAD = ["you utter blockhead", "what a blockhead move", "blockheads everywhere", "such a blockhead"]
GOOD = ["you kind friend", "what a fine move", "gardens everywhere", "such a morning", "calm sea today"]


def corpus(spark):
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        docs.append((i, f"{(BAD if toxic else GOOD)[i % 4]} number {i} on the quay"))
        labels.append((i, 0, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = score_toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 300 and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    _, labels = corpus(spark)
    docs, _ = corpus(spark)
    odd = docs.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    assert score_toxicity(odd, labels).count() == 300 + odd_documents.count()
    kept = drop_toxic(odd_documents, labels)
    assert kept.columns == odd_documents.columns
    assert {r.doc_id for r in odd_documents.subtract(kept).collect()} <= {4, 5, 8}  # few and alike: only what is labelled toxic, or looks so
    assert score_toxicity(no_documents, labels).count() == 0
    assert score_toxicity(odd_documents, labels.limit(0)).where("predicted = 1").count() == 0
