import re
import zlib
from collections import Counter
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import pytest

from hybridkb.llm import quality
from hybridkb.llm.queries import op11_quality

SCHEMA = "doc_id bigint, text string"


def plain_features(text):
    """Values of the n-grams of a text, n-grams of one repeated token counted together."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", (text or "").encode())
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(tokens) - n + 1):
            g = tuple(tokens[i : i + n])
            grams["again", n] += n > 1 and len(set(g)) == 1
            grams[g] += not (n > 1 and len(set(g)) == 1)
    total = sum(grams.values())
    return sorted(sqrt(c / total) for c in grams.values() if c)


TEXTS = ["", None, " \n ", "one", "one one one one two", "Now!! buy!! now!! (x) || €uro über-all", "\0 a\0b", "a b a b a b c", "!!", "word " * 300]


def test_features_equal_a_plain_count():
    text, bucket, value = quality.text_features(pa.array(TEXTS, type=pa.string()))
    for i, t in enumerate(TEXTS):
        assert sorted(value[text == i]) == pytest.approx(plain_features(t)), t
        assert len(set(bucket[text == i])) == (text == i).sum()


def test_n_grams_stay_inside_their_text_and_equal_texts_have_equal_features():
    alone = quality.text_features(pa.array(["b c d"]))
    among = quality.text_features(pa.array(["x a", "b c d", "e"]))
    at = among[0] == 1
    assert (alone[1] == among[1][at]).all() and (alone[2] == among[2][at]).all()


def test_long_texts_are_read_in_pieces(monkeypatch):
    whole = quality.text_features(pa.array(["ab cd ef gh " * 50, "short one"]))
    monkeypatch.setattr(quality, "PIECE", 64)
    pieces = quality.text_features(pa.array(["ab cd ef gh " * 50, "short one"]))
    assert set(pieces[1][pieces[0] == 0]) == set(whole[1][whole[0] == 0])
    assert (pieces[1][pieces[0] == 1] == whole[1][whole[0] == 1]).all()
    assert np.bincount(pieces[0], weights=pieces[2] ** 2) == pytest.approx([1, 1])
    quality.text_features(pa.array(["x" * 1000]))  # no white space to cut at


def test_updates_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    model, z, n = quality.Ftrl(), {}, {}
    for _ in range(200):
        at = rng.choice(40, size=5, replace=False)
        value, label = rng.random(5), int(rng.integers(2))
        w = {}
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            sign = 1 if zi > 0 else -1
            w[i] = 0.0 if abs(zi) <= quality.L1 else -(zi - sign * quality.L1) / ((quality.BETA + sqrt(ni)) / quality.ALPHA + quality.L2)
        p = 1 / (1 + exp(-sum(w[i] * v for i, v in zip(at, value))))
        for i, v in zip(at, value):
            g = (p - label) * v
            s = (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / quality.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
        assert model.update(at, value, label) == pytest.approx(p)
    assert all(model.z[i] == pytest.approx(z[i]) and model.n[i] == pytest.approx(n[i]) for i in z)


def test_score_equals_a_plain_sparse_product(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = np.random.default_rng(5).normal(size=(1 << quality.BUCKET_BITS) + 1).astype(np.float32)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.quality_score(docs, weights).alias("s")).collect()}
    for i, t in rows:
        _, bucket, value = quality.text_features(pa.array([t], type=pa.string()))
        assert got[i] == pytest.approx(1 / (1 + exp(-(sum(float(weights[b]) * v for b, v in zip(bucket, value)) + float(weights[-1])))))


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op11_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for y, p in held if y == 1]
    assert sum(good) == len(good)
    bad = [p for y, p in held if y == 0]
    assert len(bad) - sum(bad) >= 0.7 * len(bad)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", "a"), (1, "fine words here", "b"), (None, "fine words here", "c"), (2, None, "d"), (3, "", "e"), (4, "!! $$ !!", "f")], f"{SCHEMA}, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 6
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[None] == by[1] and by[2] == by[3]
    assert not [r for r in rows if r.doc_id is None][0].held_out
    none = quality.score_quality(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(docs.limit(0), labels.limit(0)).collect() == []


def test_repeated_ids_of_the_fit_count_once(spark):
    docs = spark.createDataFrame([(i, "good plain words") for i in range(1, 9)] + [(i, "!! $$ !! ##") for i in range(9, 17)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 9)) for i in range(1, 17)], "doc_id bigint, quality int")
    once = quality.train(docs, labels)
    assert (once == quality.train(docs.unionAll(docs), labels)).all()
    assert len(once) and (once == quality.train(docs.repartition(5), labels)).all()
