"""Filter interaction audit: what each of five filters removes, in every order they could be applied in.

One pass marks every document with the set of filters that it fails, as five bits. A part of the corpus is then a
table of 32 counts, from which ``removed(S)``, the documents that a coalition S of filters removes, follows for all
32 coalitions. Differences of coalitions give the counts of a step: filter f after the filters S removes
``removed(S + f) - removed(S)``. Shapley values are the exact constrained least-squares solution (Charnes et al.,
1988; Lundberg & Lee, 2017): the additive values nearest to ``removed`` under the Shapley kernel's weights, given
that they sum to ``removed`` of all filters. The normal equations do not depend on the counts, so they are solved
once, in rationals, for each coalition's unit vector; the solution times 120 is a matrix of integers.

Filter E asks for the smallest doc_id with the same text in the whole table. Texts are compared by SHA-256. Rows
travel without their texts; a text that many rows share is dealt over salts.

Defined results: a null text is empty; a null source belongs to the part with the empty name, as an empty one does.
Repeated rows count as often as they stand there, and rows of one doc_id are no copies of each other. A row without
doc_id is never a copy, makes no other row one, and has no labels. A document is good (toxic) if any of its labels
says so; labels for unknown documents count nowhere. An empty table has no parts. Only doc_id, text and source are
read, so other columns may have any names. Very long texts are one row of one task.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import spread_join, write_out

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SPACES = r"[\x20\x09-\x0D]+"
#: Nulls of a join key are dealt over so many salts.
NULL_SALTS = 4096


def marked_texts(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask (the bits of filters A to D that the text fails), digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    n, distinct = F.size("words").cast("bigint"), F.size(F.array_distinct("words")).cast("bigint")
    fails = [n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("bigint") > 2 * F.length("text").cast("bigint"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def marked_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (the bits of all five filters), good, toxic (0 or 1) of every document."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("salt"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id", "salt").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("good", "toxic")]).where("good + toxic > 0")
    rows = marked_texts(documents).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod("rid", F.lit(NULL_SALTS)).cast("int")).otherwise(0))
    rows = rows.hint("shuffle_merge").join(known, ["doc_id", "salt"], "left").drop("salt").fillna(0, ["good", "toxic"])
    rows = write_out(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = spread_join(rows, write_out(first, "audit-copies"), ["digest"], ["rid"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "good", "toxic")


def coalition_removals(marked: DataFrame) -> DataFrame:
    """part, total, and arrays of 32 counts by coalition: ``removed`` documents, ``good`` and ``toxic`` among them."""
    cells = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.sum("removed").alias("total"), F.collect_list(F.struct("mask", "removed", "good", "toxic")).alias("cells"))  # 32 at most

    def removed(count: str) -> Column:
        def of(s: Column) -> Column:
            return F.aggregate(F.filter("cells", lambda c: c["mask"].bitwiseAND(s) != 0), F.lit(0).cast("bigint"), lambda a, c: a + c[count])

        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), of).alias(count)

    return parts.select("part", "total", *[removed(c) for c in ("removed", "good", "toxic")])


def shapley_matrix(n: int = len(FILTERS)) -> list[list[int]]:
    """For each of n players the integer weight of each of the 2 ** n coalitions: n! times the Shapley values, as
    the solution of the kernel-weighted least squares that is constrained to be efficient."""
    everyone = (1 << n) - 1
    size = [s.bit_count() for s in range(everyone + 1)]
    weight = [Fraction(n - 1, comb(n, k) * k * (n - k)) if 0 < k < n else Fraction(0) for k in size]
    # Normal equations with the multiplier of the constraint; a column on the right for each coalition.
    rows = []
    for i in range(n):
        left = [sum((w for s, w in enumerate(weight) if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
        rows.append(left + [w if s >> i & 1 else Fraction(0) for s, w in enumerate(weight)])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == everyone)) for s in range(everyone + 1)])
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    out = [[x * factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    if any(x.denominator != 1 for row in out for x in row):
        raise ArithmeticError("n! times a Shapley value is an integer combination of the coalitions")
    return [[int(x) for x in row] for row in out]


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part, each of the 120 orders and each of its five steps."""
    table = coalition_removals(marked_documents(documents, labels))
    at = lambda counts, s: F.get(F.col(counts), s)
    values = [sum((at("removed", F.lit(s)) * k for s, k in enumerate(row) if k), F.lit(0).cast("bigint")) for row in shapley_matrix()]
    rows = table.select("*", F.array(*values).alias("values"), F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    numbers = F.transform(F.split("filter_order", ""), lambda x: F.ascii(x) - ord(FILTERS[0]))
    rows = rows.withColumn("first", F.slice(numbers, F.lit(1), F.col("step")))  # the filters up to this step
    bit_of = lambda f: F.get(F.lit([1 << k for k in range(len(FILTERS))]), f)
    after = F.aggregate("first", F.lit(0), lambda a, f: a + bit_of(f))
    rows = rows.withColumns({"f": F.element_at("first", -1), "bit": bit_of(F.element_at("first", -1)), "after": after})
    rows = rows.withColumn("before", F.col("after") - F.col("bit"))
    step = lambda counts: at(counts, F.col("after")) - at(counts, F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("removed", F.col("after"))).alias("kept"),
        step("removed").alias("removed"),
        (at("removed", F.col("bit")) - step("removed")).alias("redundant"),
        (at("removed", F.lit(ALL)) - at("removed", ALL - F.col("bit"))).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.get(F.col("values"), F.col("f")).alias("shapley"),
    )
