from pathlib import Path

import pytest

from hybridkb.llm.token_counts import RANKS_FILE, _encoding, context_totals, length_histogram, truncated_total


@pytest.mark.parametrize("whole_table", [False, True])
def test_totals_against_brute_force(spark, data, odd_documents, whole_table):
    docs = spark.read.parquet(f"{data}/documents.parquet") if whole_table else odd_documents
    encode = _encoding("test", Path(RANKS_FILE).read_bytes()).encode_ordinary
    lengths = sorted(len(encode(r.text or "")) for r in docs.collect())
    totals = context_totals(length_histogram(docs)).cache()
    for r in totals.collect():
        n = r.length
        assert (r.n_docs, r.n_fit, r.n_longer) == (lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert (r.tokens_fit, r.tokens_kept, r.tokens_cut) == (sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths), sum(max(0, x - n) for x in lengths))
    for limit in (0, 1, 50, 10**7):
        assert truncated_total(totals, limit).first()[0] == sum(min(x, limit) for x in lengths)


def test_empty(no_documents):
    assert context_totals(length_histogram(no_documents)).count() == 0
