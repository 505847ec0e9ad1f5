import random

import sentencepiece

from hybridkb.llm.sentencepiece_sa import MODEL_FILE, Encoder, Vocabulary, decode_column, encode_documents, merge

ODD = ["", " ", "Hello  world\n\t x ﬁ Ⅷ é é 日本語 🙂", "  a \x00b \r\n<s></s>", "▁a a▁b  ▁▁▁c   ", "a" * 300, "x" + " " * 40, "http://a.b/c?d=e#----....====", "def f(x):\n        return x\n"]


def test_tables_equal_the_library_and_round_trip(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 10**6)), "doc_id long, text string"))
    coded = encode_documents(docs)
    rows = coded.withColumn("back", decode_column(coded)).where(F.lit(True)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    for r in rows:
        assert r.ids == sp.encode(r.text)
        assert r.back == r.text.replace("▁", " ")


def test_side_by_side_is_what_merging_says():
    v = Vocabulary.load(MODEL_FILE)
    e, rnd = Encoder(v), random.Random(5)
    ids = e.ids.tolist()
    for n in range(4000):
        a, b = rnd.choice(ids[: 2000 if n % 2 else None]), rnd.choice(ids[: 2000 if n % 2 else None])
        assert e._side_by_side(a, b) == (merge(v.rank, v.pieces[a] + v.pieces[b]) == [v.pieces[a], v.pieces[b]])


def test_batches_reuse_and_forget_units(monkeypatch):
    import pyarrow as pa

    from hybridkb.llm import sentencepiece_sa

    monkeypatch.setattr(sentencepiece_sa, "CACHED_UNITS", 40)
    monkeypatch.setattr(sentencepiece_sa, "ADD_CHARS", 50)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    e, rnd = Encoder(Vocabulary.load(MODEL_FILE)), random.Random(3)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("aehstn,.-é日") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 9))) + rnd.choice(["", "\n", " \n\n b", "\0x"]) for _ in range(4)]
        assert e.encode(pa.array([*texts, None, ""])).to_pylist() == [*(sp.encode(t) for t in texts), [], []]


def test_odd_rows(odd_documents, no_documents):
    coded = encode_documents(odd_documents)
    assert coded.count() == odd_documents.count() and set(coded.columns) == set(odd_documents.columns)
    assert all(r.ids == [] for r in coded.where("text IS NULL OR text = ''").collect())
    assert encode_documents(no_documents).count() == 0


def test_another_operator_frees_the_workers_encoder():
    from hybridkb.llm import sentencepiece_sa
    from hybridkb.llm.common import tidy

    sentencepiece_sa._encoders["x"] = object()
    assert list(tidy([1, 2])) == [1, 2]
    assert not sentencepiece_sa._encoders
