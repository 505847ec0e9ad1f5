"""Numbers and neighbours of rows in an order, without one task for all rows of a key.

Rows are range-partitioned by key and order, so that a key with a third of all rows lies in a third of the
partitions, and written with their place. What crosses the edge of a partition is one row for each partition
and key: the number of rows before it, or the last row before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.sources.staging import stage

PLACE, PART = "_place", "_part"
LOCAL_BITS = 33  # monotonically_increasing_id: the partition above, the row's place in it below


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """The rows written in the order of the columns (nulls first), with ``_place``, which grows in that order, and
    ``_part``, the partition. Rows that are equal in all of them stand in any order among themselves."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    return stage(placed.withColumn(PART, F.shiftright(PLACE, LOCAL_BITS).cast("int")), "in-order")


def number_rows(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """The rows with a 0-based number inside each key (a null key is a key) as ``column``: the place in the partition,
    less that of the key's first row there, plus the key's rows in earlier partitions."""
    placed = in_order(rows, *keys, *order)
    runs = placed.groupBy(*keys, PART).agg(F.min(PLACE).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(PART).alias("_run"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(runs[f"_key{i}"]) for i, k in enumerate(keys)], placed[PART] == runs["_run"])
    numbered = placed.join(runs.hint("shuffle_merge"), same)
    return numbered.select(*rows.columns, (F.col(PLACE) - F.col("_first") + F.col("_before")).cast("int").alias(column))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """The rows with ``column``: the row before them in key and order as a struct, NULL for the first of a key."""
    placed = in_order(rows, *keys, *order)
    row = F.struct(*rows.columns)
    last = placed.groupBy(PART).agg(F.max_by(row, PLACE).alias("_last"))  # one row for each partition
    edges = last.select((F.lead(PART).over(Window.orderBy(PART))).alias("_next"), "_last").where("_next IS NOT NULL")
    inside = F.lag(row).over(Window.partitionBy(PART).orderBy(PLACE))
    near = placed.withColumn("_near", inside).join(F.broadcast(edges), F.col(PART) == F.col("_next"), "left")
    near = near.withColumn("_near", F.coalesce("_near", "_last"))
    same = reduce(lambda a, b: a & b, [F.col(f"_near.{k}").eqNullSafe(F.col(k)) for k in keys])
    return near.select(*rows.columns, F.when(F.col("_near").isNotNull() & same, F.col("_near")).alias(column))
