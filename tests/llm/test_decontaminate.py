import re

from hybridkb.llm.decontaminate import contamination_report, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def report(docs, items):
    rows = contamination_report(docs, items).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows), key=str)


def test_tables_against_brute_force(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert report(docs, items) == want


def test_short_items_ties_and_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "word"), (5, "Cold rain fell on the harbour all night and the boats pulled hard at their lines"), (5, "one two")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert report(odd_documents, items) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert report(no_documents, items) == []
    assert all(r[2] == 0 for r in report(odd_documents, items.limit(0)))
    kept = drop_contaminated(odd_documents, items)
    own = [c for c in odd_documents.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == c for r in kept.select(*own).collect() for c in own)
    assert kept.columns == odd_documents.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 7, 9}


def test_windows_that_begin_before_their_run_or_end_behind_it(spark, monkeypatch):
    from hybridkb.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PIECE", 4)
    monkeypatch.setattr(decontaminate, "HOT", 2)
    item = "zulu yankee xray whiskey victor uniform tango sierra romeo quebec papa oscar november"
    w = item.split()
    docs = [
        (1, " ".join(w[1:])),
        (2, " ".join(w[:12])),
        (3, "yankee xray whiskey"),
        (4, "filler " + " ".join(w[1:]) + " more words here zulu yankee"),
        (5, f"before {item} {item} behind and {' '.join(w[1:])} end"),
        *((n, " ".join(w[2:9])) for n in range(10, 16)),
        (20, " ".join([item] * 30)),
    ]
    items = [("a", item), ("b", item + " mike lima"), ("c", " ".join(w[3:5])), (None, "papa oscar")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination_report(*frames).collect()]
    assert sorted(got) == sorted((d, n, hit, bad) for d, n, hit, _, bad in brute(docs, items))
    dropped = {d for d, *_, bad in brute(docs, items) if bad}
    assert {r.doc_id for r in drop_contaminated(*frames).collect()} == {d for d, _ in docs} - dropped
