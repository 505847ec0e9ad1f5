"""Different strings are never taken for one another: Thue-Morse words collide in every polynomial hash modulo 2 ** 64."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hybridkb.llm import common
from hybridkb.llm.decontaminate import contamination_report
from hybridkb.llm.licenses import scan_licenses
from hybridkb.llm.line_dedup import dedup_lines
from hybridkb.llm.neardup import near_duplicates
from hybridkb.llm.sentencepiece_sa import MODEL_FILE, Encoder, Vocabulary, decode_column, encode_documents
from hybridkb.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id bigint, text string"


def twins(n):
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIRS = [twins(1024), twins(4096)]
DOCS = [(10 * k + i, w + tail) for k, pair in enumerate(PAIRS) for i, w in enumerate(pair) for tail in (" v w x y",)] + [(50 + k, w) for k, pair in enumerate(PAIRS) for w in pair[:1]]


def test_twins_do_collide_in_the_cheap_hash_only():
    for a, b in PAIRS:
        data = np.frombuffer((a + b).encode(), dtype=np.uint8)
        start = np.array([0, len(a)])
        end = start + len(a)
        x, y = common.span_hash(common.prefix_hash(data), start, end)
        assert x == y
        x, y = common.field_span(common.field_hash(data), start, end)
        assert x != y


def test_span_identities_do_not_depend_on_the_place():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choices(range(256), k=5000)), dtype=np.uint8)
    text = np.concatenate([data[100:900], data])
    h = common.field_hash(text)
    spans = [(i, j) for i in range(0, 800, 37) for j in range(i, 800, 53)]
    s, e = (np.array(x) for x in zip(*spans))
    one, two = common.field_span(h, s, e), common.field_span(h, s + 900, e + 900)
    assert (one == two).all()
    different = {text[i:j].tobytes() for i, j in spans}
    assert len(set(one.tolist())) == len(different)
    # The same residues as whole numbers give.
    for k, base in enumerate(common.FIELD_BASES):
        total = sum(int(common.FIELD_CODES[k][c]) * pow(base, i, 2**31 - 1) for i, c in enumerate(text)) % (2**31 - 1)
        assert int(h[-1] >> np.uint64(32 * k)) & 0xFFFFFFFF == total


def test_near_duplicates(spark):
    rows = near_duplicates(spark.createDataFrame(DOCS, SCHEMA), k=4, percent=80).collect()
    assert all(r.component_id == r.doc_id for r in rows)


def test_line_dedup(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    assert sorted(map(tuple, dedup_lines(docs).collect())) == sorted(DOCS)
    assert sorted(map(tuple, dedup_lines(docs, min_words=1).collect())) == sorted(DOCS)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PAIRS[0][0] + " a b c d e f g h i j k l"), (2, PAIRS[1][1])], "item_id bigint, text string")
    docs = [(i, t + " a b c d e f g h i j k l") for i, t in DOCS[:2]] + [(7, PAIRS[1][0]), (8, PAIRS[1][1])]
    got = {r.doc_id: (r.n_hit, sorted(r["items"])) for r in contamination_report(spark.createDataFrame(docs, SCHEMA), items).collect()}
    assert {i: n for i, (n, _) in got.items()} == {docs[0][0]: 0, docs[1][0]: 0, 7: 0, 8: 1}
    exact = [(1, PAIRS[0][0] + " a b c d e f g h i j k l"), (2, PAIRS[0][1] + " a b c d e f g h i j k l")]
    got = {r.doc_id: r.n_hit for r in contamination_report(spark.createDataFrame(exact, SCHEMA), items).collect()}
    assert got == {1: 13, 2: 0}


def test_licenses(spark):
    own = spark.createDataFrame([(str(k), pair[0] + " is the licence") for k, pair in enumerate(PAIRS)], "license_id string, text string")
    docs = [(10 * k + i, w + " is the licence") for k, pair in enumerate(PAIRS) for i, w in enumerate(pair)]
    got = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame(docs, SCHEMA), own).collect()}
    assert got == {0: ["0"], 1: [], 10: ["1"], 11: []}


def test_sentencepiece(spark):
    encoded = encode_documents(spark.createDataFrame(DOCS, SCHEMA))
    rows = encoded.select("text", decode_column(encoded).alias("back"), "ids").collect()
    assert all(r.text == r.back for r in rows) and len({tuple(r.ids) for r in rows}) == len(DOCS)


def test_units_that_share_a_hash_keep_their_own_tokens(monkeypatch):
    texts = ["boat oar", "tide boat", "oar sails", "", "tide"] * 20 + [" ".join(f"w{i}" for i in range(300))]
    encode = lambda: Encoder(Vocabulary.load(MODEL_FILE)).encode(pa.array(texts)).to_pylist()
    want = encode()
    monkeypatch.setattr("hybridkb.llm.sentencepiece_sa.field_span", lambda h, s, e: np.zeros(len(s), dtype=np.uint64) + (e - s).astype(np.uint64) % np.uint64(3))
    assert encode() == want


def test_suffix_dedup(spark):
    docs = [(1, PAIRS[0][0] + "|" + "q" * 40), (2, PAIRS[0][1] + "|" + "r" * 40)]
    plain = lambda rows: {i: brute for i, brute in brute_force(rows)}
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == plain(docs)


def brute_force(docs, length=100):
    seen = set()
    for i, t in docs:
        b = t.encode()
        gone = set()
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone |= set(range(p, p + length))
            seen.add(b[p : p + length])
        yield i, bytes(c for p, c in enumerate(b) if p not in gone)


def test_suffix_dedup_of_repeated_and_missing_ids_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdefgh ", k=150)) for _ in range(6)]
    rows = [(rng.choice([1, 2, 2**63 - 1, None]), "".join(rng.sample(passages, 3)) + str(k)) for k in range(24)] + [(2**63 - 1, passages[0] * 2), (None, passages[0] * 2)]
    out = []
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("p", F.expr("hash(text)")).orderBy("p").drop("p").repartition(n)
        out.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in remove_repeats(df).collect()))
    assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)
    assert {r[1] for r in out[0] if not r[0]} == {1, 2, 2**63 - 1}


@pytest.mark.parametrize("name", ["line_dedup", "near_duplicates", "decontamination", "sentencepiece"])
def test_stages_keep_both_twins(spark, tmp_path, name):
    full = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, "some item text of a benchmark")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, full, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(DOCS)
