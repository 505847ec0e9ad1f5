"""Numbers and neighbours of rows whose key holds much of the table."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from hybridkb.operators import numbering, records
from hybridkb.sources import tables


@contextmanager
def many_partitions(spark):
    """Small tables stay in many partitions too."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_rows(n=900):
    rng = random.Random(2)
    return [(("hot" if i % 2 else rng.choice(["a", "b", None, "c"])), i * 7919 % n) for i in range(n)]


def test_numbers_of_a_hot_key(spark):
    rows = hot_rows()
    with many_partitions(spark):
        placed = numbering.in_order(spark.createDataFrame(rows, "k string, o int"), "k", "o")
        sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
        got = [(r.k, r.o, r.ordinal) for r in tables.assign_ordinals(spark.createDataFrame(rows, "k string, o int"), "k", "o").collect()]
    assert len(sizes) == 7 and max(sizes) < len(rows) / 3  # the hot key's rows lie in several partitions
    by = {}
    for k, o in rows:
        by.setdefault(k, []).append(o)
    assert sorted(got, key=str) == sorted([(k, o, n) for k, os in by.items() for n, o in enumerate(sorted(os))], key=str)


def test_previous_rows_cross_partitions(spark):
    rows = hot_rows()
    with many_partitions(spark):
        out = numbering.with_previous(spark.createDataFrame(rows, "k string, o int"), ["k"], ["o"], "before")
        got = {(r.k, r.o): r.before and r.before.o for r in out.collect()}
    by = {}
    for k, o in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append(o)
    assert got == {(k, o): (os[i - 1] if i else None) for k, os in by.items() for i, o in enumerate(os)}


@pytest.mark.parametrize("n", [1, 3])
def test_moves_of_a_hot_item(spark, n):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else rng.choice("abc"), rng.choice(["p", "q", "r", None]), i) for i in range(800)]
    with many_partitions(spark):
        found = records.latest_moves(spark.createDataFrame(rows, "item string, place string, at int").repartition(5), "item", "place", "at", n)
        got = {r["item"]: (r.current, r.n_moves, r.latest) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    want = {}
    for item in {r[0] for r in rows}:
        places = []
        for p in [r[1] for r in rows if r[0] == item]:
            if not places or places[-1] != p:
                places.append(p)
        want[item] = (places[-1], len(places) - 1, places[-2 : -2 - n : -1])
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, o int")
    assert numbering.number_rows(none, ["k"], ["o"], "n").collect() == []
    assert numbering.with_previous(none, ["k"], ["o"], "before").collect() == []
    assert records.latest_moves(none.withColumn("p", F.lit("x")), "k", "p", "o").collect() == []
