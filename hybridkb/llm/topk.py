"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are turned into integers. For a segmentation into s segments of length l, with segment means m and
deviations d, the squared distance of two vectors is at least sum l * ((m1 - m2) ** 2 + (d1 - d2) ** 2), so
with the vectors' norms their inner product is at most sum l * (m1 * m2 + d1 * d2). The bounds are taken
coarse to fine; pairs that survive the finest one get their exact product.

Queries and candidates are cut into blocks, and every cell of the grid of blocks is one group of a cogroup:
the usual fragment-and-replicate plan, whose groups have a bounded size whatever the tables' size. A cell
returns k rows for each of its queries; a window over those picks the k best.

Components are floor(256 * x). Vectors that are null, empty, or hold null or non-finite components take no
part; vectors only meet others of their length. Ties go to the smaller id; a row never meets rows of its own
id. Rows that repeat an id count once each as candidates of others; as a query, the one with the smallest vector,
component by component, asks. Rows with a null id take no part. Empty tables give empty results, and columns other
than the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
SEGMENTS = (4, 16)
EXACT = 2**53


def _statistics(x: np.ndarray, s: int) -> np.ndarray:
    """Means and deviations of s segments, scaled so that a product of rows is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(s, x.shape[1]))
    cols = []
    for p in parts:
        part = x[:, p]
        cols += [part.mean(axis=1) * np.sqrt(len(p)), part.std(axis=1) * np.sqrt(len(p))]
    return np.stack(cols, axis=1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, one for each row pair."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ij->i", q, c)


def _pairwise(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Products of the rows of a and b where alive, -inf elsewhere: pair by pair if few are alive, as one
    matrix product if many are."""
    out = np.full(alive.shape, -np.inf)
    if np.count_nonzero(alive) * 20 > alive.size:
        np.copyto(out, a @ b.T, where=alive)
        return out
    r, j = np.nonzero(alive)
    for x in range(0, len(r), 65536):
        s = slice(x, x + 65536)
        out[r[s], j[s]] = np.einsum("ij,ij->i", a[r[s]], b[j[s]])
    return out


def block_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best of each query within one cell; c is sorted by id."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    stats = [(_statistics(qf, s), _statistics(cf, s)) for s in SEGMENTS]
    out_q, out_c, out_s = [], [], []
    for a in range(0, len(q), 256):
        rows = slice(a, min(a + 256, len(q)))
        bound = stats[0][0][rows] @ stats[0][1].T
        own = q_ids[rows, None] == c_ids[None, :]
        bound[own] = -np.inf
        # The exact products of the most promising few give each query its first threshold.
        few = min(4 * k, bound.shape[1])
        seeds = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        r = np.repeat(np.arange(bound.shape[0]), few)
        seed = _products(q[rows][r], c[seeds.ravel()]).astype(np.float64).reshape(-1, few)
        seed[own[r, seeds.ravel()].reshape(-1, few)] = -np.inf
        floor = -np.sort(-seed, axis=1)[:, min(k, few) - 1] if few >= k else np.full(bound.shape[0], -np.inf)
        slack = 1e-9 * (np.abs(bound[np.isfinite(bound)]).max(initial=1.0) + 1)
        alive = (bound >= floor[:, None] - slack) & ~own
        for sq, sc in stats[1:]:
            finer = _pairwise(sq[rows], sc, alive)
            alive &= finer >= floor[:, None] - slack
        if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT:
            score = _pairwise(qf[rows], cf, alive)  # integers below 2 ** 53: exact in double
            if score.shape[1] > k:  # a query's k-th best drops the rest before anything is sorted
                alive &= score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            r, j = np.nonzero(alive)
            score = score[r, j].astype(np.int64)
        else:
            r, j = np.nonzero(alive)
            score = np.concatenate([_products(q[rows][r[x : x + 65536]], c[j[x : x + 65536]]) for x in range(0, len(r), 65536)] or [np.zeros(0, np.int64)])
        order = np.lexsort((c_ids[j], -score, r))
        r, j, score = r[order], j[order], score[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        best = nth < k
        out_q.append(r[best] + a)
        out_c.append(c_ids[j[best]])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _integers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    good = F.size(v) > 0
    good = good & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & good).select(F.col(id_column).cast("bigint").alias("id"), ints.alias("v"), F.size(v).alias("dim"))


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best integer inner products."""
    asked, held = (_integers(t, id_column, vector_column) for t in (queries, vectors))
    # Counted before repeated ids go, which only makes more blocks.
    n_query = max(1, -(-asked.count() // QUERY_BLOCK))
    n_held = max(1, -(-held.count() // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    left = asked.withColumn("qb", block(n_query)).withColumn("cb", across(n_held))
    right = held.withColumn("cb", block(n_held)).withColumn("qb", across(n_query))

    def cell(qs: pa.Table, cs: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], type=t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        if not qs.num_rows or not cs.num_rows:
            return empty
        cs = cs.sort_by("id")
        mats = []
        for t in (qs, cs):
            flat = t.column("v").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            mats.append(flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))
        ids = qs.column("id").to_numpy()
        r, c, s = block_top_k(ids, mats[0], cs.column("id").to_numpy(), mats[1], k)
        return pa.table({"query_id": ids[r], "vec_id": c, "score": s})

    keys = ["dim", "qb", "cb"]
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
