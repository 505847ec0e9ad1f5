import re
from itertools import permutations

from hybridkb.llm import filter_audit

SCHEMA = "doc_id bigint, text string, source string"


def brute_force(docs, labels):
    """All rows by applying every order to every document, one after the other."""
    good = {i for i, q, t in labels if i is not None and q == 1}
    toxic = {i for i, q, t in labels if i is not None and t == 1}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = [r for r in own if f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def as_rows(found):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}


def documents():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " Aa", "A B C " * 100, "short", "short", "", None, long + " |", "word " * 300, "TEXT # " + long, "a\x0bb c d", long, "ÉTEXT É"]
    docs = [(k * 3 % 40, texts[k % len(texts)], ["s1", "s2", None, ""][k % 4]) for k in range(60)]
    docs += [(None, "short", "s1"), (None, "short", "s1"), (None, None, None), (3, long, "s2"), (3, long, "s3"), (3, long, "s3")]
    labels = [(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(0, 45, 2)] + [(4, 1, None), (6, None, 0), (None, 1, 1), (900, 1, 1)]
    return docs, labels


def test_equals_brute_force(spark):
    docs, labels = documents()
    got = filter_audit.audit_filters(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert as_rows(got) == brute_force(docs, labels)


def test_hot_texts_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr("hybridkb.llm.common.HOT", 3)
    docs, labels = documents()
    got = filter_audit.audit_filters(spark.createDataFrame(docs, SCHEMA).repartition(7), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert as_rows(got) == brute_force(docs, labels)


def test_shapley_weights_are_those_of_all_orders():
    matrix = filter_audit.shapley_matrix()
    plain = [[0] * 32 for _ in range(5)]
    for p in permutations(range(5)):
        before = 0
        for f in p:
            plain[f][before] -= 1
            plain[f][before | 1 << f] += 1
            before |= 1 << f
    for row, expected in zip(matrix, plain, strict=True):
        assert row[1:] == expected[1:]  # the empty coalition removes nothing


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.audit_filters(odd_documents, labels)
    assert rows.count() == 600 and {r.part for r in rows.select("part").distinct().collect()} == {"s"}
    assert filter_audit.audit_filters(no_documents, labels).collect() == []
    last = rows.where("step = 5").select("kept").distinct().collect()
    assert len(last) == 1
