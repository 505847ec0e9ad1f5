"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (3 to 6 characters of the lower-cased text, within a word or at
its edge), hashed to 2 ** 20 buckets. Each feature is scaled by its log-count ratio between the toxic and the
other training documents, and a logistic regression is fitted on the scaled features (Wang & Manning, 2012).

The fit takes at most ``max_per_class`` labelled documents of each class, those with the smallest hash of
their id; scoring covers whole texts of all documents. Null and empty texts get the score of the bias alone.
Labels with a null id or label, or for unknown documents, are ignored; several labels for a document count as
toxic if any is. Without labels of both classes every score is 0. Repeated rows are scored alike; for the fit, a
document in several rows counts once, by its smallest text. Very long texts are scored whole. An empty table gives an empty result. Columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hybridkb.llm.common import fresh_name, give_back, mix64, slices_by_bytes, tidy

BUCKET_BITS = 20
SIZES = (3, 4, 5, 6)
CHUNK = 1 << 19
MAX_PER_CLASS = 3000
THRESHOLD = 0.7

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalnum() for i in range(0x110000)], dtype=bool))
    return _letter[0]


def text_features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct feature numbers of each text."""
    clean = [(t or "").replace("\0", " ").lower() for t in texts]
    joined = "\0" + "\0".join(clean) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 0)
    edge = ~_letters()[codes]
    symbols = np.where(edge, np.uint64(32), codes.astype(np.uint64) + np.uint64(64))
    breaks = np.concatenate(([0], np.cumsum(edge)))
    found = []
    g = symbols.copy()
    for n in range(2, SIZES[-1] + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        g = g[:m] * np.uint64(0x9E3779B185EBCA87) + symbols[n - 1 : n - 1 + m]
        if n < SIZES[0]:
            continue
        at = np.flatnonzero(breaks[n - 1 : n - 1 + m] == breaks[1 : 1 + m])  # no break between first and last
        found.append((at, (mix64(g[at] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)))
    cuts = [np.searchsorted(at, ends) for at, _ in found]
    last = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
    out = []
    for i in range(len(texts)):
        # An n-gram that begins at the mark before a text belongs to it, one at the mark behind it does not.
        idx = np.concatenate([f[c[i] : c[i + 1]] for c, (_, f) in zip(cuts, found, strict=True)] or [np.zeros(0, np.int64)])
        order = np.arange(len(idx), dtype=np.int32)
        last[idx] = order
        out.append(idx[last[idx] == order])
    return out


def fit(features: list[np.ndarray], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, smooth: float = 1.0, least: int = 2) -> np.ndarray:
    """Weights of all buckets, and the bias behind them. Features of fewer than ``least`` documents have none."""
    size = 1 << BUCKET_BITS
    weights = np.zeros(size + 1, dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        weights[-1] = -40.0
        return weights
    counts = np.full((2, size), smooth)
    for f, y in zip(features, labels, strict=True):
        counts[int(y), f] += 1
    ratio = np.log((counts[1] / (2 * smooth + (labels == 1).sum())) / (counts[0] / (2 * smooth + (labels == 0).sum())))
    ratio[counts.sum(axis=0) < 2 * smooth + least] = 0
    v, squares, bias, bias_squares = np.zeros(size), np.full(size, 1e-3), 0.0, 1e-8
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(features)):
            f = features[i]
            r = ratio[f]
            slope = 1.0 / (1.0 + np.exp(-np.clip(bias + float(v[f] @ r), -40, 40))) - labels[i]
            grad = slope * r
            squares[f] += grad * grad
            v[f] -= rate * grad / np.sqrt(squares[f])
            bias_squares += slope * slope
            bias -= rate * slope / np.sqrt(bias_squares)
    weights[:-1] = v * ratio
    weights[-1] = bias
    return weights


def training_share(doc_id: Column) -> Column:
    """True for rows that labels may be learned from: crc32 of the id's text mod 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> np.ndarray:
    """The classifier's weights: fitted in one task on a sample of bounded size."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.where(training_share(F.col("_id")) & F.col("_toxic").isin(0, 1)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    pick = [known.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class) for y in (0, 1)]
    sample = pick[0].unionByName(pick[1])  # 2 * max_per_class rows at most
    docs = documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text"))
    texts = docs.join(F.broadcast(sample), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select("_toxic", "_text")

    def featurise(batches):
        for batch in tidy(batches):
            for at, n in slices_by_bytes(batch.column(1), CHUNK):
                found = text_features(batch.column(1).slice(at, n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array([f.astype(np.uint32).tobytes() for f in found], type=pa.binary())], names=["toxic", "features"]
                )

    def fit_one(table: pa.Table) -> pa.Table:
        y = table.column("toxic").to_numpy()
        rows = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("features")]
        order = sorted(range(len(rows)), key=lambda i: (int(y[i]), len(rows[i]), rows[i].tobytes()))
        return pa.table({"weights": pa.array([fit([rows[i] for i in order], y[order]).tobytes()], type=pa.binary())})

    found = texts.mapInArrow(featurise, "toxic int, features binary").withColumn("one", F.lit(1))
    made = found.groupBy("one").applyInArrow(fit_one, "weights binary").collect()
    if not made:
        return fit([], np.zeros(0))
    return np.frombuffer(made[0][0], dtype=np.float32)


def toxicity_score(documents: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """A column with the score of a text column, from 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = shared.value
        out = np.empty(len(texts))
        for at, n in slices_by_bytes(texts, CHUNK):
            out[at : at + n] = [w[f].sum(dtype=np.float64) for f in text_features(texts.slice(at, n).to_pylist())]
        give_back()
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out + float(w[-1]), -40, 40))))

    return score(F.col(text).cast("string"))


def score_toxicity(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights = train(documents, labels, max_per_class)
    scored = documents.select(F.col("doc_id").alias("doc_id"), toxicity_score(documents, weights).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    weights = train(documents, labels, max_per_class)
    score = fresh_name(documents.columns, "score")
    return documents.withColumn(score, toxicity_score(documents, weights)).where(F.col(score) < threshold).drop(score)
