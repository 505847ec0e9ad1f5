"""Exact pruning in BM25, item lookup by the rarest piece, the audit, embeddings."""

import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hybridkb.operators import lexical, records
from hybridkb.sources import tables


def corpus(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    chunks = [(i, "shared" if i % 3 else "vessel", " ".join(rng.choices(words, weights, k=rng.randint(0, 40))), i % 7 > 0) for i in range(400)]
    queries = [(q, " ".join(rng.choices(words, k=6)) + " w0 w1 w2" + (" w3-w4" if q % 2 else "")) for q in range(25)] + [(90, ""), (91, "nowhere"), (92, "w0"), (93, "w59 w59 w0")]
    return spark.createDataFrame(chunks, "chunk_id bigint, layer string, content string, is_active boolean"), spark.createDataFrame(queries, "query_id bigint, text string")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("layers", [None, ["vessel"]])
def test_pruning_keeps_every_best_chunk(spark, seed, layers):
    chunks, queries = corpus(spark, seed)
    kept = lexical.layer_filter(chunks, layers).select("chunk_id")
    whole = lexical.top_by(lexical.bm25_scores(queries, chunks).join(kept, "chunk_id", "left_semi"), "score", 5)
    want = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in whole.collect()}
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in lexical.bm25_search(queries, chunks, layers, 5).collect()}
    assert got == want


def test_common_phrases_are_looked_up_for_few_chunks(spark):
    chunks, queries = corpus(spark, 3)
    asks, weights = lexical.bm25_parts(queries, chunks)
    parted = lexical.split_phrases(asks, weights, 3)
    joined = lambda asked: weights.join(asked.select("query_id", "phrase"), "phrase").count()
    before, after = joined(parted), joined(parted.where("NOT spare"))
    assert parted.where("spare").count() and after < 0.7 * before


@pytest.mark.parametrize("hint", ["broadcast", "shuffle_merge"])
def test_lookup_by_the_rarest_piece(spark, monkeypatch, hint):
    monkeypatch.setattr(records, "size_hint", lambda *a: hint)
    monkeypatch.setattr(records, "DEALT", 3)
    rng = random.Random(1)
    items = [(i, "".join(rng.choice("abcÄ ") for _ in range(rng.randint(0, 9))), rng.choice([None, "abcabc", "B%_"])) for i in range(200)]
    texts = ["abc", "ABCA", "a", "", None, "ä ", "%_", "zzz", "abcz", "c a", "bcab", "ab", "abcabca"]
    asked = list(enumerate(texts))
    found = records.find_items(spark.createDataFrame(items, "item_id bigint, a string, b string"), spark.createDataFrame(asked, "query_id bigint, text string"), ["a", "b"])
    got = [(r.query_id, r.item_id) for r in found.collect()]
    want = {(q, i) for q, t in asked if t is not None for i, *f in items if any(t.lower() in x.lower() for x in f if x is not None)}
    assert len(got) == len(set(got)) and set(got) == want


def test_lookup_without_questions(spark):
    items = spark.createDataFrame([(1, "abc")], "item_id bigint, a string")
    none = records.find_items(items, spark.createDataFrame([(1, None)], "query_id bigint, text string"), ["a"])
    assert none.collect() == [] and set(none.columns) == {"query_id", "item_id", "a"}
    assert records.find_items(items.limit(0), spark.createDataFrame([(1, "abc")], "query_id bigint, text string"), ["a"]).collect() == []


def test_audit_names_each_fault(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = tables.integrity_audit(
        make([(1, "shared", "p"), (2, "shared", "p"), (3, "attic", "q"), (4, None, "r"), (5, "vessel", "p")], "source_id int, layer string, path string"),
        make([(1, 0), (1, 0), (1, 1), (9, 0), (None, 5)], "source_id int, ordinal int"),
        make([(1,), (77,), (None,)], "chunk_id int"),
        make([(1,), (2,)], "chunk_id int"),
        make([(1, "bow"), (2, "bow"), (3, None), (4, None)], "zone_id int, name string"),
        make([(1, 1, 1), (1, 1, 1), (1, 1, 2)], "zone_id int, row int, col int"),
        make([("Spare", 1), ("boat", 8), (None, None)], "category string, zone_id int"),
    )
    got = {(r["rule"], r["item"]): r.n for r in found.collect()}
    want = {
        ("source path", "shared|p"): 2, ("source layer", "attic"): 1, ("source layer", ""): 1, ("chunk ordinal", "1|0"): 2, ("chunk source", "9"): 1, ("vector chunk", "77"): 1,
        ("zone name", "bow"): 2, ("zone slot", "1|1|1"): 2, ("item category", "boat"): 1, ("item zone", "8"): 1,
    }
    assert got == want


def murmur3(data, seed=42):
    """MurmurHash3, 32 bits, as a signed number."""
    h, mask = seed, 0xFFFFFFFF
    rotl = lambda x, r: (x << r | x >> 32 - r) & mask
    mix = lambda k: rotl(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    n = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:n]):
        h = (rotl(h ^ mix(k), 13) * 5 + 0xE6546B64) & mask
    h ^= mix(int.from_bytes(data[n:], "little")) if data[n:] else 0
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def test_hashed_embeddings_against_a_plain_count(spark):
    rows = [(1, "Oil the winch, oil it WELL"), (2, ""), (3, None), (4, "été à bord 4JH45-W001"), (5, "x " * 500)]
    got = {r.chunk_id: r.embedding for r in tables.hashed_embedding(spark.createDataFrame(rows, "chunk_id int, content string")).collect()}
    import re

    for i, text in rows:
        counts = Counter(murmur3(t.encode()) % 384 for t in re.findall(r"[^\W_]+", (text or "").lower()))
        norm = sum(c * c for c in counts.values()) ** 0.5
        assert got[i] == pytest.approx([counts[k] / norm if norm else 0 for k in range(384)], abs=1e-6)


def test_scorers_get_64_texts_and_are_checked(spark):
    chunks = spark.range(150).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("content")).coalesce(1)
    got = tables.embed_attach(chunks, lambda texts: [[float(len(texts)), float(len(t))] for t in texts], 2).orderBy("chunk_id").collect()
    assert {r.embedding[0] for r in got} == {64.0, 22.0} and [r.embedding[1] for r in got] == [float(len(r.content or "")) for r in got]
    for scorer in (lambda texts: [[1.0, 2.0]], lambda texts: [[1.0] for _ in texts]):
        with pytest.raises(Exception, match="vectors for|dimension"):
            tables.embed_attach(chunks, scorer, 2).collect()
    assert tables.embed_attach(chunks.limit(0), lambda texts: [], 2).collect() == []


def test_a_task_sums_up_a_bounded_number_of_pairs(spark, monkeypatch):
    chunks, queries = corpus(spark, 4)
    asks, weights = lexical.bm25_parts(queries, chunks, ("layer",))
    assert {"df", "n_chunks"} <= set(asks.columns) and "layer" in weights.columns
    whole = sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in lexical.bm25_scores(queries, chunks).collect())
    monkeypatch.setattr(lexical, "PAIRS", 200)
    scores = lexical.bm25_scores(queries, chunks, ("layer",)).withColumn("task", F.spark_partition_id())
    rows = scores.collect()
    assert sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in rows) == whole
    assert all(r.layer == ("shared" if r.chunk_id % 3 else "vessel") for r in rows)
    most = max(Counter(r.task for r in rows).values())
    assert len(rows) > 5000 and most < 1000, most


def test_a_value_that_some_rows_reach(spark):
    rng = random.Random(6)
    rows = [(k, rng.random() * 3) for k in (1, 2, 3) for _ in range(50 * k)] + [(9, 0.5)]
    got = {r.k: (r.most, r.least) for r in lexical.reached(spark.createDataFrame(rows, "k int, v double"), "k", "v", 20, 8).collect()}
    for k in (1, 2, 3):
        values = sorted((v for x, v in rows if x == k), reverse=True)
        assert got[k][0] == values[0] and values[19] - 1 / 8 < got[k][1] <= values[19]
    assert got[9] == (0.5, 0.0)
