"""Exact nearest neighbours of a table of query vectors among a table of chunk vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.operators.lexical import layer_filter, top_by

BLOCK = 4096
ROWS = 256  # queries of a block that meet the other block at a time


def _nearest(ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, chunk id, distance) of the ``pool`` nearest of each query: a matrix product leaves those that may
    be among them, whose distances are then summed from differences."""
    square, c_square = (q * q).sum(axis=1), (c * c).sum(axis=1)
    near = square[:, None] + c_square[None, :] - 2 * (q @ c.T)
    keep = min(pool, len(c))
    if keep < 1:
        return ids[:0], c_ids[:0], square[:0]
    limit = np.partition(near, keep - 1, axis=1)[:, keep - 1]
    slack = 1e-8 * (1 + square.max() + c_square.max())
    r, j = np.nonzero(~(near > limit[:, None] + slack))
    d = np.sqrt(((c[j] - q[r]) ** 2).sum(axis=1))
    order = np.lexsort((c_ids[j], np.round(d, 9), r))
    r, j, d = r[order], j[order], d[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < keep
    return ids[r[best]], c_ids[j[best]], d[best]


def knn_search(queries: DataFrame, chunks: DataFrame, layers: list[str] | None = None, pool: int = 20) -> DataFrame:
    """query_id, chunk_id, distance (L2 in double), rank; null vectors take no part.

    Both sides are cut into blocks and every pair of blocks is one group of a cogroup, so a task holds a
    bounded number of vectors and returns ``pool`` rows for each query."""
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    held = layer_filter(chunks, layers).where("embedding IS NOT NULL").select("chunk_id", "embedding")
    n_q, n_c = (max(1, -(-t.count() // BLOCK)) for t in (asked, held))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", block("query_id", n_q)).withColumn("cb", across(n_c)).withColumn("dim", F.size("embedding"))
    right = held.withColumn("cb", block("chunk_id", n_c)).withColumn("qb", across(n_q)).withColumn("dim", F.size("embedding"))

    def cell(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if qs.num_rows and cs.num_rows:
            q, c = (t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) for t in (qs, cs))
            ids, c_ids = qs.column("query_id").to_numpy(), cs.column("chunk_id").to_numpy()
            for a in range(0, len(q), ROWS):
                out.append(_nearest(ids[a : a + ROWS], q[a : a + ROWS], c_ids, c, pool))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table({"query_id": cols[0], "chunk_id": cols[1], "distance": cols[2]})

    keys = ["dim", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id bigint, chunk_id bigint, distance double")
    return top_by(found, "distance", pool)
