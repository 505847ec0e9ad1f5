import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridkb.llm import spelling


def one_edit(w):
    alphabet = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in alphabet)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in alphabet if c != w[i])


def near_by_edits(words):
    return {(w, x) for w in words for x in one_edit(w) if x in words and x != w}


def brute_force(docs):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {}
    for w, x in near_by_edits(words):
        near.setdefault(w, []).append((-words[x], x))
    form = {w: min(v)[1] for w, v in near.items() if -min(v)[0] >= 5 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near.get(w, [])), words[form[w]] if w in form else None)
    return out


def some_documents():
    rng = random.Random(4)
    base = ["planks", "harbour", "éclairage", "mooring", "anchorage", "aaaaaaa", "halyard", "ÿÿÿÿÿÿ", "schooner"]
    words = []
    for w in base:
        words += [w] * 300
        edits = sorted({e for e in one_edit(w) if e[:1].isalpha()})
        for e in rng.sample(edits, 12):
            words += [e] * rng.choice([4, 5, 8, 60])
            words += [rng.choice(sorted(one_edit(e)))] * rng.choice([5, 10])
    rng.shuffle(words)
    docs = [(k, " ".join(x.upper() if k % 3 == 0 and x.isascii() else x for x in words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    return docs + [(None, "planks Éclairage planks-planks planks"), (None, None), (7, ""), (7, "planks")]


@pytest.mark.parametrize("bucket_words", [4096, 5])
def test_equals_brute_force(spark, bucket_words):
    docs = some_documents()
    got = spelling.spelling_forms(spark.createDataFrame(docs, "doc_id bigint, text string"), bucket_words=bucket_words)
    rows = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()}
    want = brute_force(docs)
    assert rows == want and any(v[1] != v[0] and v[0] for v in want.values())


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_short_alphabets_are_found_once(spark, seed):
    """Words that share nearly everything: buckets are split until a letter is left."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(400)})
    rows = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = [(r.word, r.near) for r in spelling.near_words(rows, bucket_words=[2, 20, 100, 4096][seed]).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_edits(set(words))


def test_kernel_on_words_of_many_lengths():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(700)})
    import numpy as np

    size = np.array([len(w) for w in words])
    i, j = spelling.near_pairs(pa.array(words), size, np.zeros(len(words), int), np.full(len(words), spelling.NO_GUARD))
    got = [tuple(sorted((words[x], words[y]))) for x, y in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted(p)) for p in near_by_edits(set(words))}


def test_long_words(spark):
    long = "ab" * 20_000
    words = [long, long + "c", "c" + long, long[:-1] + "c", long[:20_000] + long[20_001:], "planks"]
    rows = spark.createDataFrame([(w, 9) for w in words], "word string, n bigint")
    got = {(r.word, r.near) for r in spelling.near_words(rows).collect()}

    def apart(x, y):
        if len(x) > len(y):
            x, y = y, x
        k = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
        return x[k + (len(x) == len(y)) :] == y[k + 1 :]

    assert got == {(x, y) for x in words for y in words if x != y and abs(len(x) - len(y)) < 2 and apart(x, y)}


def test_odd_rows(spark, odd_documents, no_documents):
    got = spelling.spelling_forms(odd_documents)
    want = brute_force([(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()])
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == want
    assert spelling.spelling_forms(no_documents).collect() == []
    assert spelling.spelling_forms(odd_documents.where(F.col("doc_id") == 4)).collect() == []
