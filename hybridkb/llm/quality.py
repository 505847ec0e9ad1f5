"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates and
scored as sparse dot products.

A text's tokens are maximal runs of letters, digits and bytes beyond ASCII, and maximal runs of other marks that are
no white space. Features are its n-grams of 1 to 3 tokens, hashed to 2 ** 20 buckets; an n-gram of one token
repeated falls to the bucket of its length, whatever the token. A feature's value is the square root of its share
of the text's n-grams, so that texts of all lengths have a vector of length one. Weights follow FTRL-Proximal
(McMahan et al., 2013): per-coordinate rates, L1 and L2 terms; steps on the rarer class are larger, so that both
classes weigh the same.

The fit takes at most ``max_per_class`` labelled documents of each class, those with the smallest hash of their id,
and streams them through one task in a fixed order, ``epochs`` times; that task holds three arrays of 2 ** 20
numbers and one batch. Scores cover whole texts of all documents. Texts of more than PIECE bytes are read in
pieces, cut behind white space where there is any; n-grams do not reach over a cut.

Null and empty texts, and texts of white space alone, get the score of the bias. Repeated rows are scored alike; for
the fit, a document in several rows counts once, by its smallest text. Rows without doc_id are scored and belong to
no training share. Labels with a null id or a label other than 0 and 1, or for unknown documents, are ignored;
of several labels for a document the largest counts. Without labels of both classes every score is 0.5. An empty
table gives an empty result. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hybridkb.llm.common import GOLDEN, give_back, mix64, field_hash, slices_by_bytes, field_span, text_buffers, tidy, write_out

BUCKET_BITS = 20
LONGEST = 3
PIECE = 1 << 20
BATCH = 1 << 18
MAX_PER_CLASS = 3000
EPOCHS = 8
THRESHOLD = 0.3
HOLD_OUT = 5
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.02, 0.02

SPACE, WORD, MARK = 0, 1, 2
KINDS = np.full(256, MARK, dtype=np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = WORD


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the pieces of all texts: whole texts, but for those of more than PIECE bytes."""
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while hi - lo > PIECE:
            space = np.flatnonzero(KINDS[data[lo + PIECE // 2 : lo + PIECE]] == SPACE)
            cut = lo + (PIECE // 2 + int(space[-1]) + 1 if len(space) else PIECE)
            yield lo, cut
            lo = cut
        yield lo, hi


def _n_grams(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first byte, bucket) of every n-gram of the texts between ``edges``, never across one."""
    kind = KINDS[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[edges[edges < len(data)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] != SPACE
    starts, ends = starts[real], ends[real]
    token = field_span(field_hash(data), starts, ends)
    owner = np.searchsorted(edges, starts, side="right")
    places, buckets = [], []
    for n in range(1, LONGEST + 1):
        m = len(token) - n + 1
        if m <= 0:
            break
        inside = np.flatnonzero(owner[:m] == owner[n - 1 : n - 1 + m])
        x = token[inside].copy()
        same = np.full(len(inside), n > 1)
        for j in range(1, n):
            same &= token[inside] == token[inside + j]
            x = mix64(x + GOLDEN) + token[inside + j]
        x[same] = n  # a repeated token, whichever it is
        places.append(starts[inside])
        x += np.uint64(n * int(GOLDEN) % 2**64)
        buckets.append((mix64(x) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(buckets)


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of every feature of every text, sorted by text and bucket."""
    data, offsets = text_buffers(column)
    counted: list[tuple[np.ndarray, np.ndarray]] = []

    def count(lo: int, cuts: list[int]) -> None:
        at, bucket = _n_grams(data[lo : cuts[-1]], np.array(cuts[:-1], dtype=np.int64) - lo)
        text = np.searchsorted(offsets, at + lo, side="right") - 1
        counted.append(np.unique((text << BUCKET_BITS) | bucket, return_counts=True))

    lo, cuts = 0, []
    for _, hi in _pieces(data, offsets):
        if cuts and hi - lo > PIECE:
            count(lo, cuts)
            lo, cuts = cuts[-1], []
        cuts.append(hi)
    if cuts and cuts[-1] > lo:
        count(lo, cuts)
    if not counted:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, n = (np.concatenate(x) for x in zip(*counted, strict=True))
    if len(counted) > 1:  # a long text's pieces share features
        key, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(key))
    text, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    total = np.bincount(text, weights=n, minlength=len(column))
    return text, bucket, np.sqrt(n / total[text])


class Ftrl:
    """Weights of hashed features under FTRL-Proximal updates; the last entry is the bias."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BUCKET_BITS) + 1), np.zeros((1 << BUCKET_BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        far = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * far / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, value: np.ndarray, label: int, cost: float = 1.0) -> float:
        """One step on one document's features, the bias among them; the probability before it."""
        w = self.weights(at)
        p = float(1.0 / (1.0 + np.exp(-np.clip(w @ value, -40, 40))))
        g = cost * (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def held_out(doc_id: Column, parts: int = HOLD_OUT) -> Column:
    """True for rows whose labels are never learned: crc32 of the id's text mod ``parts`` is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, epochs: int = EPOCHS, label: str = "quality") -> np.ndarray:
    """The weights of all buckets and of the bias, or an empty array without labels of both classes."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & ~held_out(F.col("_id")) & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    pick = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class) for y in (0, 1)]
    sample = pick[0].unionByName(pick[1])  # 2 * max_per_class rows at most
    docs = documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text"))
    texts = docs.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def featurise(batches):
        for batch in tidy(batches):
            for at, n in slices_by_bytes(batch.column(2), BATCH):
                text, bucket, value = text_features(batch.column(2).slice(at, n))
                cuts = np.searchsorted(text, np.arange(n + 1))
                rows = [(bucket[a:b].astype(np.uint32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                kept = [batch.column(i).slice(at, n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[i] for r in rows], type=pa.binary()) for i in (0, 1))], names=["_id", "_y", "bucket", "value"])

    def fit(batches):
        model = Ftrl()
        bias = np.array([1 << BUCKET_BITS])
        for batch in tidy(batches):
            for y, b, v in zip(batch.column("_y").to_pylist(), batch.column("bucket"), batch.column("value"), strict=True):
                at = np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.uint32).astype(np.int64), bias])
                model.update(at, np.append(np.frombuffer(v.as_buffer(), dtype=np.float32).astype(np.float64), 1.0), y, cost[y])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()], type=pa.binary())], names=["weights"])

    found = write_out(texts.mapInArrow(featurise, "_id bigint, _y int, bucket binary, value binary"), "quality-sample")
    counts = dict(found.groupBy("_y").count().collect())
    if len(counts) < 2:
        return np.zeros(0, dtype=np.float32)
    cost = {y: sum(counts.values()) / (2 * n) for y, n in counts.items()}  # both classes weigh the same
    turns = found.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("h", F.xxhash64("_id", "epoch"))
    # One task reads the bounded sample as a stream.
    ordered = turns.repartition(1).sortWithinPartitions("epoch", "h", "_id").select("_y", "bucket", "value")
    return np.frombuffer(ordered.mapInArrow(fit, "weights binary").first()[0], dtype=np.float32)


def quality_score(documents: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """A column with the score of a text column, from 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 4 MB

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = shared.value
        out = np.zeros(len(texts))
        if len(w):
            for at, n in slices_by_bytes(texts, BATCH):
                row, bucket, value = text_features(texts.slice(at, n))
                out[at : at + n] = np.bincount(row, weights=w[bucket] * value, minlength=n) + float(w[-1])
        give_back()
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -40, 40))))

    return score(F.col(text).cast("string"))


def score_quality(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights = train(documents, labels, max_per_class)
    scored = documents.select(F.col("doc_id").alias("doc_id"), quality_score(documents, weights).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
