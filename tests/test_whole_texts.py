"""Registered queries see whole texts: nothing of a line or of a question is cut off before the operator."""

import math
import re
from collections import Counter

import pytest

from hybridkb.operators import chunking
from hybridkb.plans import catalog
from hybridkb.plans.chunking import _markdown
from hybridkb.plans.tables import chunks, table


def tokens(text):
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def test_sections_hold_every_line(spark, data):
    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect() if r.text and r.text.strip()}
    found = {}
    for r in chunking.markdown_sections(_markdown(spark, data)).collect():
        found.setdefault(r.doc_id, []).append(r.content)
    assert set(found) == set(docs)
    for doc_id, text in docs.items():
        words = Counter(" ".join(found[doc_id]).split())
        assert not Counter(text.split()) - words
    assert catalog.entries()["markdown_sections"][0](spark, data).select("doc_id").distinct().count() == len(docs)


def test_questions_keep_all_their_words(spark, data):
    phrases = catalog.entries()["query_phrases"][0](spark, data)
    got = Counter((r.query_id, r.term) for r in phrases.collect())
    assert got == Counter((r.item_id, t) for r in table(spark, data, "benchmark").collect() for t in tokens(r.text))


def test_bm25_of_whole_questions_against_brute_force(spark, data):
    rows = chunks(spark, data).select("chunk_id", "content", "is_active").collect()
    docs = {r.chunk_id: tokens(r.content) for r in rows}
    active = {r.chunk_id for r in rows if r.is_active}
    average = sum(map(len, docs.values())) / len(docs)
    holders = {}
    for c, d in docs.items():
        for x in d:
            holders.setdefault(x, set()).add(c)
    want = {}
    for q in table(spark, data, "benchmark").collect():
        scores = Counter()
        for phrase in filter(None, map(tokens, q.text.split())):
            tf = {c: n for c in holders.get(phrase[0], ()) if (n := sum(docs[c][i : i + len(phrase)] == phrase for i in range(len(docs[c]))))}
            idf = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
            for c, n in tf.items():
                scores[c] -= idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[c]) / average))
        best = sorted((round(s, 9), c) for c, s in scores.items() if c in active)[:20]
        want |= {(q.item_id, n): s for n, (s, _) in enumerate(best, 1)}
    got = {(r.query_id, r.rank): r.score for r in catalog.entries()["bm25_search"][0](spark, data).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
