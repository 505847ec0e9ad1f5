import random

import numpy as np
import pytest

from hybridkb.llm import neardup
from hybridkb.llm.neardup import drop_near_duplicates, near_duplicates, super_minhash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("few", "hot"), [(16, 1000), (1, 3)])
def test_edited_copies_of_one_text_against_brute_force(spark, few, hot, monkeypatch):
    """A hub with copies that are mostly not linked with each other, chains, short texts and exact copies."""
    from hybridkb.llm import common

    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(common, "HOT", hot)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(90):
        w = list(base)
        for p in rnd.sample(range(150), rnd.randint(1, 8)):
            w[p] = f"e{i}_{p}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(8):
        rows.append((200 + i, " ".join(chain[i * 2 :] + [f"t{j}" for j in range(i * 2)])))
    rows += [(300, "a b"), (301, "A  B"), (302, "a b c d e f"), (303, rows[5][1]), (304, None), (305, " ")]
    want = brute(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == want


@pytest.mark.parametrize("n_families", [2, 3])
def test_a_second_family_near_the_hub_makes_no_pairs_of_its_members(spark, monkeypatch, n_families):
    """Families of m members each: near to the first family's, but not linked, and linked within. Members of two
    families on either side of the hub's may meet, but those of one never do."""
    counts = {}
    plain = neardup.write_out

    def counted(df, name):
        out = plain(df, name)
        counts[name] = counts.get(name, 0) + (out.count() if name in ("rest", "pairs") else 0)
        return out

    monkeypatch.setattr(neardup, "write_out", counted)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    families = []
    for f in range(n_families):
        w = list(base)
        for p in range(7 * f, 7 * f + 7 * (f > 0)):
            w[p * 6 + 3] = f"f{f}_{p}"
        families.append(w)
    rows, m = [], 60
    for f, w in enumerate(families):
        for i in range(m):
            x = list(w)
            x[rnd.randrange(200)] = f"e{f}_{i}"
            rows.append((f * 1000 + i, " ".join(x)))
    want = brute(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == want
    assert counts["rest"] <= (4 * len(rows) if n_families == 2 else m * m + 4 * len(rows)), counts


def test_parts_of_one_text_far_from_their_hub_make_no_pairs(spark, monkeypatch):
    """Edited copies of a text, and of its first half: the halves are far from the buckets' hubs and share most of
    their shingles, but few pairs are linked. Pairs that are compared grow no faster than the rows."""
    counts = {}
    plain = neardup.write_out

    def counted(df, name):
        out = plain(df, name)
        counts[name] = counts.get(name, 0) + (out.count() if name == "rest" else 0)
        return out

    monkeypatch.setattr(neardup, "write_out", counted)
    rnd = random.Random(7)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        w = list(base[: 150 if i < 40 else 70])
        for p in rnd.sample(range(len(w)), 1 if i < 40 else rnd.randint(1, 3)):
            w[p] = f"e{i}_{p}"
        rows.append((i, " ".join(w)))
    rows += [(200, " ".join(base)), (201, " ".join(base[:70]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    assert counts["rest"] <= 2 * len(rows), counts


def test_odd_rows(odd_documents, no_documents):
    rows = near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].component_id == 1 and not by_id[6].kept and by_id[1].kept and by_id[8].kept
    assert by_id[2].n_shingles == by_id[3].n_shingles == by_id[7].n_shingles == 0
    kept = drop_near_duplicates(odd_documents)
    own = [c for c in odd_documents.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == c for r in kept.select(*own).collect() for c in own)
    assert kept.columns == odd_documents.columns and 6 not in {r.doc_id for r in kept.collect()}
    assert near_duplicates(no_documents).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [whole[:300], whole[60:360], whole[:3]]
    sig = super_minhash(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.12
    assert (sig[2] < 128).all() and len(set(map(tuple, sig.tolist()))) == 3
