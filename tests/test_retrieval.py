"""Fusion, slots, gate and overrides against the rules written out in plain Python, on made-up lists."""

import random

from hybridkb.operators import fusion

N = 4


def lists(spark, seed, questions=30):
    """Random ranked lists of chunk ids for each question, as plain dicts and as DataFrames."""
    rnd = random.Random(seed)
    knn, bm25 = {}, {}
    for q in range(questions):
        knn[q] = [(c, round(0.2 + 0.11 * i, 3)) for i, c in enumerate(rnd.sample(range(40), rnd.randint(0, 9)))]
        bm25[q] = [(c, round(-9.5 + 1.3 * i, 3)) for i, c in enumerate(rnd.sample(range(40), rnd.randint(0, 9)))]
    frame = lambda d, value: spark.createDataFrame([(q, c, v, i + 1) for q, x in d.items() for i, (c, v) in enumerate(x)], f"query_id long, chunk_id long, {value} double, rank int")
    return knn, bm25, frame(knn, "distance"), frame(bm25, "score")


def fused(knn, bm25):
    a, b = ({c: i for i, (c, _) in enumerate(x, 1)} for x in (knn, bm25))
    score = {c: sum(1 / (60 + r[c]) for r in (a, b) if c in r) for c in {*a, *b}}
    return sorted(score, key=lambda c: (-score[c], a.get(c, 99), b.get(c, 99)))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.pos)):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_fusion(spark):
    knn, bm25, k, b = lists(spark, 1)
    want = {q: fused(knn[q], bm25[q]) for q in knn}
    assert by_query(fusion.rrf_fuse(k, b).collect()) == {q: x for q, x in want.items() if x}


def test_slot(spark):
    knn, bm25, k, b = lists(spark, 2)
    asked = {q: ["where are the spare lines kept", "part 7 of the pump", "which tank leaks"][q % 3] for q in knn}
    weak = {q: q % 2 == 0 for q in knn}
    b = b.withColumn("score", b["score"] + (b["query_id"] % 2 == 0).cast("int") * 6)
    got = by_query(fusion.exact_slot(fusion.rrf_fuse(k, b), b, spark.createDataFrame(list(asked.items()), "query_id long, text string"), N).collect())
    for q in knn:
        want = fused(knn[q], bm25[q])[:N]
        if bm25[q]:
            first, score = bm25[q][0][0], bm25[q][0][1] + 6 * weak[q]
            if (any(c.isdigit() for c in asked[q]) or score <= -5) and first not in want:
                want = [*want[: N - 1], first]
        assert got.get(q, []) == want


def test_gate(spark):
    knn, bm25, k, b = lists(spark, 3)
    k, b = k.withColumn("distance", k["distance"] + k["query_id"] % 3 * 0.6), b.withColumn("score", b["score"] + b["query_id"] % 2 * 4.4)
    queries = spark.createDataFrame([(q,) for q in [*knn, 777]], "query_id long")
    got = {r.query_id: r.refused for r in fusion.below_floor(queries, k, b).collect()}
    for q in knn:
        near = min([d + q % 3 * 0.6 for _, d in knn[q]], default=None)
        best = min([s + q % 2 * 4.4 for _, s in bm25[q]], default=None)
        strong = best is not None and best <= -5 or near is not None and near <= 1
        assert got[q] is (not strong)
    assert got[777] is True


def pulled(ids, pairs, n):
    """The rule in words: superseding pairs first, then by target; what lacks one side brings it in."""
    ids, pairs = list(ids), sorted(pairs, key=lambda p: (p[2] != "supersede", p[0]))
    taken = {x for t, v, _ in pairs for x in (t, v)}
    incoming = [v if t in ids else t for t, v, _ in pairs if (t in ids) != (v in ids)]
    for new in incoming:
        spare = [i for i, c in enumerate(ids) if c not in taken]
        if new not in ids and len(ids) >= n and spare:
            ids[spare[-1]] = new
        elif new not in ids:
            ids.append(new)
    return ids


def test_overrides_come_in(spark):
    rnd = random.Random(6)
    tops, pairs = {}, {}
    for q in range(120):
        tops[q] = rnd.sample(range(12), rnd.randint(1, N))
        targets = rnd.sample(range(12), rnd.randint(0, 5))
        pairs[q] = [(t, rnd.choice([x for x in range(12) if x != t]), rnd.choice(["supersede", "annotate"])) for t in targets]
    top = spark.createDataFrame([(q, c, i + 1) for q, x in tops.items() for i, c in enumerate(x)], "query_id long, chunk_id long, pos int")
    links = spark.createDataFrame([(q, *p) for q, x in pairs.items() for p in x], "query_id long, target_id long, vessel_id long, relation string")
    working = fusion.override_pull_in(top, links, N)
    want = {q: pulled(tops[q], pairs[q], N) for q in tops}
    assert by_query(working.collect()) == want
    for r in fusion.down_rank(working, links, N).collect():
        over = [k for t, v, k in pairs[r.query_id] if t == r.chunk_id and v in want[r.query_id]]
        assert r.note == (f" [NOTE: {over[0]}d by vessel note]" if over else "")


def test_nearest_neighbours_against_plain_distances(spark):
    import math

    from hybridkb.operators.vector import knn_search

    rnd = random.Random(8)
    vectors = {i: [rnd.choice([0.0, 0.5, 1.0]) for _ in range(5)] for i in range(60)}
    chunks = spark.createDataFrame([(i, v, "shared", True) for i, v in vectors.items()], "chunk_id long, embedding array<float>, layer string, is_active boolean")
    queries = spark.createDataFrame([(i, vectors[i]) for i in range(0, 60, 7)] + [(99, None)], "query_id long, embedding array<float>")
    got = {}
    for r in knn_search(queries, chunks, None, 6).collect():
        got[r.query_id, r.rank] = (r.chunk_id, round(r.distance, 6))
    for q in range(0, 60, 7):
        order = sorted((round(math.dist(vectors[q], v), 9), c) for c, v in vectors.items())[:6]
        assert [got[q, n] for n in range(1, 7)] == [(c, round(d, 6)) for d, c in order]
    assert not any(q == 99 for q, _ in got)


def test_entry_runs(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert {"query_id", "pos", "chunk_id", "refused"} <= set(out.columns) and out.count() > 0


def test_texts_take_no_part_in_the_join_with_vectors(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["pump", "winch", "mast", "sail", "rope", "keel", "#12"])
    rows = [(i, ["shared", "vessel", "community"][i % 3], " ".join(word() for _ in range(8)), i % 5 > 0, i - 1 if i % 6 == 1 else None, None, [rnd.random() for _ in range(4)] if i % 4 else None) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, layer string, content string, is_active boolean, supersedes_id long, annotates_id long, embedding array<float>")
    queries = spark.createDataFrame([(q, " ".join(word() for _ in range(3)), [rnd.random() for _ in range(4)] if q % 3 else None) for q in range(9)], "query_id long, text string, embedding array<float>")
    keep = lambda t: sorted((r.query_id, r.pos or 0, r.chunk_id or -1, r.note or "") for r in t.collect())
    apart = fusion.retrieve(queries, chunks.drop("embedding"), vectors=chunks.drop("content"))
    assert keep(apart) == keep(fusion.retrieve(queries, chunks)) and apart.count() >= 9


def test_few_ranked_rows_do_not_move_the_texts(spark):
    from hybridkb.operators.context import chunk_metadata

    chunks = spark.createDataFrame([(i, "shared", f"s{i}", f"text {i}") for i in range(50)], "chunk_id long, layer string, source string, content string")
    ranked = spark.createDataFrame([(1, 1, 7, ""), (1, 2, 99, ""), (2, 1, 8, "!")], "query_id long, pos int, chunk_id long, note string").repartition(3, "query_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cited = chunk_metadata(ranked, chunks)
        assert "BroadcastHashJoin" in cited._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r.pos, r.title, r.content, r.note) for r in cited.collect()) == [(1, 1, "s7", "text 7", ""), (2, 1, "s8", "text 8", "!")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms_of_different_chunks_are_counted_without_a_join(spark, monkeypatch):
    """In place of a join and two counts, batches are looked up; repeated or missing ids take the join. Both give the same."""
    from hybridkb.operators import lexical

    texts = ["a b a-b b", "", None, "B c, a b a b", "x " * 3000 + "a b", "é É a", "c"]
    phrases = spark.createDataFrame([(1, 0, "a", 1), (2, 0, "b", 1), (3, 0, "a", 2), (3, 1, "b", 2), (4, 0, "a", 3), (4, 1, "b", 3), (4, 2, "a", 3), (5, 0, "é", 1), (6, 0, "q", 1)], "phrase long, off int, term string, phrase_len int")
    chunks = spark.createDataFrame([(i, "s" if i % 2 else None, t) for i, t in enumerate(texts)], "chunk_id long, layer string, content string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = lexical.phrase_counts(phrases, chunks, ("layer",))
    assert "Join" not in plan(found) and "MapInArrow" in plan(found)
    got = sorted(map(tuple, found.collect()), key=str)
    assert (3, "s", 6, 3, 2) in got and (3, "s", 6, 4, 1) in got and (0, None, 5, 1, 2) in got and not [r for r in got if r[0] == 2]
    monkeypatch.setattr(lexical, "TERMS", 3)
    assert sorted(map(tuple, lexical.phrase_counts(phrases, chunks, ("layer",)).collect()), key=str) == got
    monkeypatch.setattr(lexical, "size_hint", lambda *a: "shuffle_merge")
    joined = lexical.phrase_counts(phrases, chunks, ("layer",))
    assert "Join" in plan(joined) and sorted(map(tuple, joined.collect()), key=str) == got
    monkeypatch.undo()
    for odd in (chunks.unionByName(chunks), chunks.unionByName(chunks.where("chunk_id = 0").selectExpr("CAST(NULL AS BIGINT) AS chunk_id", "layer", "content"))):
        assert "Join" in plan(lexical.phrase_counts(phrases, odd, ("layer",)))
    assert lexical.phrase_counts(phrases, chunks.limit(0), ("layer",)).count() == 0
