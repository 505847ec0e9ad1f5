import math
import random

from hybridkb.llm.topk import exact_top_k


def test_against_brute_force_with_ties_and_odd_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(7)]) for i in range(120)]
    rows += [(i, list(rows[3][1])) for i in range(120, 140)]
    rows += [(200, None), (201, []), (202, [float("nan")] * 7), (203, [None] * 7), (204, [1.0, 2.0]), (None, [1.0] * 7), (205, [float("inf")] * 7)]
    v = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, label int, score string")
    got = {}
    for r in exact_top_k(v.where("vec_id % 10 = 0"), v, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = {}
    for q in good:
        if q % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q and len(good[c]) == len(good[q]))[:5]
            want[q] = [(n + 1, c, -x) for n, (x, c) in enumerate(s)]
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}
    assert exact_top_k(v.limit(0), v.limit(0)).count() == 0


def test_of_repeated_query_ids_the_smallest_vector_asks(spark):
    rows = [(0, [1.0, 0.0]), (0, [-1.0, 0.5]), (0, [-1.0, 0.25]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [-1.0, 0.0])]
    for n in (1, 4):
        v = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, score string").repartition(n)
        got = [(r["rank"], r.vec_id, r.score) for r in exact_top_k(v.where("vec_id = 0"), v, 3).orderBy("rank").collect()]
        assert got == [(1, 3, 65536), (2, 2, 64 * 256), (3, 2, -64 * 256)]
