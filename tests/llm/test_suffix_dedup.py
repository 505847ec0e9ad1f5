import random

import pytest

from hybridkb.llm import suffix_dedup
from hybridkb.llm.run_length_index import RunLengthIndex


def brute(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def run(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}


@pytest.mark.parametrize(("index_bytes", "hot"), [(2 << 20, 100_000), (600, 1)])
def test_against_brute_force(spark, data, index_bytes, hot, monkeypatch):
    """With small indexes all anchors are cut again; with few hot rows all buckets are dealt over salts."""
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", index_bytes)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(hot)
    text = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    passages = [text(rnd.randint(90, 400)) for _ in range(6)]
    rows = [(i, text(rnd.randint(0, 80)) + rnd.choice(passages)[rnd.randint(0, 30) :] + text(40) + rnd.choice(passages)) for i in range(60)]
    # One phrase of less, just and more than 100 bytes between different neighbours.
    for n in (60, 99, 100, 130):
        phrase = text(n)
        rows += [(200 + n + 1000 * i, text(90) + phrase + text(90)) for i in range(25)]
    rows += [(100, "x" * 350), (101, "ab" * 200), (102, rows[0][1]), (103, ""), (104, "x" * 99)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd_documents, no_documents):
    rows = suffix_dedup.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].n_removed == by_id[6].n_bytes and by_id[2].n_bytes == 0
    assert suffix_dedup.remove_repeats(no_documents).count() == 0


def test_matching_statistics_against_brute_force():
    import numpy as np

    rnd = random.Random(9)
    for _ in range(40):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30))).encode() for _ in range(5)]
        pattern = "".join(rnd.choice("abc") for _ in range(40)).encode()
        symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int32) + 1, 0) for t in texts]).astype(np.int32)
        index = RunLengthIndex(symbols, max(map(len, texts)))
        p = np.frombuffer(pattern, np.uint8).astype(np.int32) + 1
        for _, start, length in index.matching(p, np.array([len(p)]), np.array([len(p)]), 12):
            s = int(start[0])
            want = max(n for n in range(len(p) - s + 1) if any(pattern[s : s + n] in t for t in texts))
            assert min(int(length[0]), 12) == min(want, 12)


def test_memory_of_a_slab():
    """An executor has a Python worker for each core, and all of them beside its heap."""
    import tracemalloc

    import numpy as np

    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 100, suffix_dedup.SLAB).astype(np.uint8)
    data[1_650_000:1_700_000] = 120  # of one letter at the end of a long text
    offsets = np.concatenate([np.arange(0, 300_001, 1000), np.arange(1_700_000, suffix_dedup.SLAB, 1000), [suffix_dedup.SLAB]])
    suffix_dedup.segments_by_pieces(data, offsets, 100)  # powers are kept
    tracemalloc.start()
    _, lo, hi, anchor, whole = suffix_dedup.segments_by_pieces(data, offsets, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    # Every start of a string is in one segment, and equal strings have equal anchors.
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    sizes = np.diff(offsets)
    want = np.concatenate([np.arange(a, a + n - 99) for a, n in zip(offsets[:-1], sizes, strict=True) if n >= 100])
    assert np.array_equal(np.sort(starts), want)
    by_string = {}
    for k in rnd.choice(len(lo), 2000):
        by_string.setdefault(data[lo[k] : lo[k] + 100].tobytes(), set()).add(int(anchor[k]))
    assert all(len(x) == 1 for x in by_string.values())
