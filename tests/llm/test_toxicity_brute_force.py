"""The features, ratios, fit and score of the toxicity classifier against plain Python."""

import random
from collections import Counter
from math import exp, log, sqrt

import numpy as np
import pytest

from hybridkb.llm import toxicity

TEXTS = ["", None, "a", "ab", "You utter blockhead!", "don't  stop", "ÄÖü ßtraße 日本語 x", "  ...  ", "one\ntwo\0three", "aaaaaaaa aaaaaaaa", "x" * 50 + " y"]


def plain_features(text):
    """Runs of 3 to 6 characters of the lower-cased text that no mark or blank stands inside of, marks being alike."""
    chars = ["_" if not c.isalnum() else c for c in "\0" + (text or "").replace("\0", " ").lower() + "\0"]
    out = set()
    for n in range(3, 7):
        for i in range(len(chars) - n + 1):
            gram = tuple(chars[i : i + n])
            if "_" not in gram[1:-1]:
                out.add(gram)
    return out


def test_features_equal_a_plain_list():
    found = toxicity.text_features(TEXTS)
    for t, f in zip(TEXTS, found, strict=True):
        assert len(f) == len(set(f.tolist())) == len(plain_features(t)), t
    # A text's features do not depend on its neighbours, and equal n-grams have equal numbers.
    for t, f in zip(TEXTS, found, strict=True):
        assert set(toxicity.text_features([t])[0].tolist()) == set(f.tolist())
    a, b = toxicity.text_features(["blockhead here", "no blockhead"])
    assert len(set(a.tolist()) & set(b.tolist())) == len(plain_features("blockhead here") & plain_features("no blockhead"))


def plain_fit(rows, labels, epochs, rate, smooth, least):
    count = [Counter(), Counter()]
    for f, y in zip(rows, labels, strict=True):
        count[y].update(f)
    n = [labels.count(y) for y in (0, 1)]
    ratio = {}
    for f in set(count[0]) | set(count[1]):
        if count[0][f] + count[1][f] >= least:
            ratio[f] = log((count[1][f] + smooth) / (n[1] + 2 * smooth)) - log((count[0][f] + smooth) / (n[0] + 2 * smooth))
    v, squares, bias, bias_squares = Counter(), {}, 0.0, 1e-8
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            p = 1 / (1 + exp(-(bias + sum(v[f] * ratio.get(f, 0.0) for f in rows[i]))))
            for f in rows[i]:
                g = (p - labels[i]) * ratio.get(f, 0.0)
                squares[f] = squares.get(f, 1e-3) + g * g
                v[f] -= rate * g / sqrt(squares[f])
            bias_squares += (p - labels[i]) ** 2
            bias -= rate * (p - labels[i]) / sqrt(bias_squares)
    return {f: v[f] * ratio.get(f, 0.0) for f in v}, bias


def test_fit_and_score_equal_a_plain_loop(spark):
    rng = random.Random(3)
    words = ["calm", "sea", "rope", "mast", "fool", "idiot", "wind"]
    texts = [" ".join(rng.choices(words[:5] if k % 2 else words[2:], k=rng.randint(1, 6))) for k in range(60)]
    labels = [k % 2 for k in range(60)]
    found = toxicity.text_features(texts)
    weights = toxicity.fit(found, np.array(labels), epochs=3)
    want, bias = plain_fit([f.tolist() for f in found], labels, 3, 0.05, 1.0, 2)
    assert all(weights[f] == pytest.approx(w, abs=1e-5) for f, w in want.items()) and weights[-1] == pytest.approx(bias, abs=1e-5)
    assert np.count_nonzero(weights[:-1]) <= len(want)
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.toxicity_score(docs, weights).alias("s")).collect()}
    for i, t in enumerate([*texts, None, ""]):
        plain = sum(want.get(f, 0.0) for f in toxicity.text_features([t])[0].tolist()) + bias
        assert got[i] == pytest.approx(1 / (1 + exp(-plain)), abs=1e-4)
