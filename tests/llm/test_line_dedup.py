import random

from hybridkb.llm.line_dedup import dedup_lines

BLANKS = " \t\x0b\f\r"


def brute(rows, least=5):
    first, runs = {}, []
    for i, t in sorted(rows):
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        n = [len(x.encode().split()) for x in lines]
        found = set()
        for a in range(len(lines)):
            for step in (1, -1):
                b, total = a, 0
                while 0 <= b < len(lines):
                    total += n[b]
                    if total >= least:
                        found.add((min(a, b), max(a, b) + 1))
                        break
                    b += step
        for a, b in sorted(found):
            first.setdefault(tuple(lines[a:b]), (i, a))
            runs.append((i, a, b, tuple(lines[a:b])))
    dead = {}
    for i, a, b, key in runs:
        if first[key] < (i, a):
            dead.setdefault(i, set()).update(range(a, b))
    out = {}
    for i, t in rows:
        kept, at = [], 0
        for x in t.split("\n"):
            if x.strip(BLANKS):
                if at not in dead.get(i, ()):
                    kept.append(x)
                at += 1
            else:
                kept.append(x)
        out[i] = "\n".join(kept)
    return out


def test_runs_of_short_and_long_lines_against_brute_force(spark):
    rnd = random.Random(3)
    pool = ["a", "b b", "c c c", "d d d d d d", "e", "f f", "", " "]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.8 else f"u{i} {rnd.random()}" for _ in range(rnd.randint(1, 14)))) for i in range(80)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd_documents, no_documents):
    out = dedup_lines(odd_documents)
    own = [c for c in odd_documents.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == c for r in out.select(*own).collect() for c in own)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r.text for r in rows}
    assert by_id[2] is None and by_id[3] == "" and by_id[6].strip() == ""
    assert dedup_lines(no_documents).count() == 0
