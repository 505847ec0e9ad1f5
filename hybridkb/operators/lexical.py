"""BM25 over phrases, for a table of queries against a table of chunks.

Scores are negative, the best the lowest. Statistics cover all chunks; layer and activity filters apply to
what is ranked. Postings are cut to the queries' terms before anything is shuffled; each different phrase is
counted once in each chunk, whatever the number of queries that ask it, and these counts are written out. Only
then do they meet the queries, chunk by chunk. The search for the best chunks prunes exactly: bounds for each
phrase tell which phrases cannot lift a chunk into the list by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from hybridkb.functions.text import tokens, words
from hybridkb.sources.staging import size_hint, stage

K1, B = 1.2, 0.75
TEXT_BYTES = 8 << 20  # of text that one task cuts into terms
TERMS = 1 << 19  # that a batch looks up at once
PAIRS = 1 << 19  # of chunk and query that one task sums up


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase_no, off, term, phrase_len: each white-space token is a phrase of one or more terms."""
    phrases = queries.select("query_id", F.posexplode(words(F.col("text"))).alias("phrase_no", "phrase"))
    terms = phrases.select("query_id", "phrase_no", tokens(F.col("phrase")).alias("terms")).where(F.size("terms") > 0)
    return terms.select("query_id", "phrase_no", F.posexplode("terms").alias("off", "term"), F.size("terms").alias("phrase_len"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """n_chunks, avg_len: one row."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(tokens(F.col("content")))).alias("avg_len"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """term, n_chunks_with."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks_with"))


def _parts(batch: pa.RecordBatch, column: int):
    """The batch cut where the lists of a column hold more than ``TERMS`` values together, one row at least."""
    offs = batch.column(column).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + TERMS, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _counted(indexed: DataFrame, asked: DataFrame, about: tuple[str, ...]) -> DataFrame:
    """``phrase_counts`` of chunks (chunk_id, about, t: terms) that are one row each, for phrases within the bounds of a
    broadcast: a batch's terms are looked up at once, and counted by row, phrase and place of the phrase."""
    rows = asked.toArrow()
    phrase, off, size = (rows.column(c).to_numpy() for c in ("phrase", "off", "phrase_len"))
    every, back = np.unique(phrase, return_inverse=True)
    terms, code = np.unique(rows.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    order = np.argsort(code, kind="stable")
    known = every, pa.array(terms, type=pa.string()), np.searchsorted(code[order], np.arange(len(terms) + 1)), back[order], off[order].astype(np.int64), size[order].astype(np.int64)
    shared = indexed.sparkSession.sparkContext.broadcast(known)
    names = ["chunk_id", *about]

    def count(batches):
        every, terms, first, number, off, size = shared.value
        for batch in (b for whole in batches for b in _parts(whole, len(names))):
            lists = batch.column(len(names))
            here = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            lens = lists.value_lengths().drop_null().to_numpy()
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
            hit = np.flatnonzero(code >= 0)
            row = np.repeat(np.arange(len(here)), lens)[hit]
            place = hit - (np.cumsum(lens) - lens)[row]
            n = np.diff(first)[code[hit]]
            row, place = np.repeat(row, n), np.repeat(place, n)
            ask = np.repeat(first[code[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key, long = row * len(every) + number[ask], size[ask]
            alone = long == 1
            # A longer phrase begins where as many of its terms say so as it has.
            begin = (place - off[ask])[~alone] + int(off.max())
            wide = int(lens.max(initial=0)) + int(off.max()) + 1
            start, first_of, times = np.unique(key[~alone] * wide + begin, return_index=True, return_counts=True)
            whole = start[times == long[~alone][first_of]] // wide
            found, tf = np.unique(np.concatenate([key[alone], whole, np.arange(len(here)) * len(every)]), return_counts=True)
            row = found // len(every)
            kept = batch.select(names).take(pa.array(here[row]))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(lens[row], pa.int32()), pa.array(every[found % len(every)]), pa.array(tf, pa.int64())], names=[*names, "len", "phrase", "tf"]
            )

    schema = StructType([*(indexed.schema[c] for c in names), StructField("len", IntegerType()), StructField("phrase", LongType()), StructField("tf", LongType())])
    return indexed.select(*names, "t").mapInArrow(count, schema)


def phrase_counts(phrases: DataFrame, chunks: DataFrame, about: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, about, len, phrase, tf: how often each different phrase (a number) of ``phrases`` stands in each chunk. The
    phrase 0 stands once in every chunk, so that the lengths of all chunks come out of the same pass. Texts move once, to
    tasks of ``TEXT_BYTES`` each, where all of a chunk is counted; columns of the chunk that ``about`` names come along.
    Rows that share a chunk_id, or have none, count as one chunk if they are equally long, and are joined with the phrases."""
    every = chunks.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("phrase"), F.lit(0).alias("off"), F.lit("").alias("term"), F.lit(1).alias("phrase_len"))
    asked = stage(phrases.select("phrase", "off", "term", "phrase_len").distinct().unionByName(every), "phrases")
    ids = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("size"))
    size, most, unnamed = ids.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("n"), F.count_if(F.col("chunk_id").isNull())).first()
    texts = chunks.select("chunk_id", *about, "content").repartition(max(1, -(-size // TEXT_BYTES)), "chunk_id")
    indexed = texts.select("chunk_id", *about, tokens(F.col("content")).alias("t"))
    hint = size_hint(asked, "term")
    if hint == "broadcast" and most == 1 and not unnamed:
        return _counted(indexed, asked, about)
    postings = indexed.select("chunk_id", *about, F.size("t").alias("len"), F.posexplode(F.concat(F.array(F.lit("")), "t")).alias("pos", "term"))
    alone = F.col("phrase_len") == 1
    start = F.when(alone, 0).otherwise(F.col("pos") - F.col("off")).alias("at")
    keys = ["chunk_id", *about, "len", "phrase"]
    hits = postings.join(asked.hint(hint), "term").groupBy(*keys, "phrase_len", start).agg(F.count(F.lit(1)).alias("n"))
    times = F.when(alone, F.col("n")).when(F.col("n") == F.col("phrase_len"), 1)
    return hits.groupBy(*keys).agg(F.sum(times).alias("tf")).where("tf > 0")


def bm25_parts(queries: DataFrame, chunks: DataFrame, about: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(asks, weights): query_id, phrase (its number), factor (how often asked, times idf), df, n_chunks, and chunk_id, about,
    phrase, weight (the saturated count). A chunk's score for a query is minus the sum of factor times weight."""
    phrases = query_phrases(queries)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "term"))), lambda x: x["term"]), " ")
    keys = phrases.groupBy("query_id", "phrase_no").agg(whole.alias("text"), F.max("phrase_len").alias("phrase_len"))
    keys = stage(keys, "questions")
    # Numbers instead of texts make what is shuffled and counted small; they hold as they are written out.
    names = stage(keys.select("text", "phrase_len").distinct().withColumn("phrase", F.monotonically_increasing_id() + 1), "names")
    split = names.select("phrase", "phrase_len", F.posexplode(F.split("text", " ")).alias("off", "term"))
    counts = stage(phrase_counts(split, chunks, about), "counts")
    n, average = counts.where("phrase = 0").agg(F.count(F.lit(1)), F.coalesce(F.avg("len"), F.lit(0.0))).first()
    counts = counts.where("phrase <> 0")
    df_ = F.col("df")
    known = counts.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).select("phrase", "df", F.greatest(F.log((n - df_ + 0.5) / (df_ + 0.5)), F.lit(1e-6)).alias("idf"))
    known = known.hint("shuffle_merge").join(names.select("phrase", "text"), "phrase")
    asks = keys.groupBy("query_id", "text").agg(F.count(F.lit(1)).alias("times"))
    asks = asks.hint("shuffle_merge").join(known, "text").select("query_id", "phrase", (F.col("times") * F.col("idf")).alias("factor"), "df", F.lit(n).cast("bigint").alias("n_chunks"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (average or 1.0)))
    return asks, counts.select("chunk_id", *about, "phrase", weight.alias("weight"))


def _sums(asks: DataFrame, weights: DataFrame, about: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, about, sum of factor times weight. A task sums up the pairs of some of the chunks with all queries,
    ``PAIRS`` at most on average, whatever the number of chunks."""
    reach = asks.groupBy("query_id").agg(F.least(F.sum("df"), F.max("n_chunks")).alias("n"))
    pairs = reach.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = weights.repartition(max(1, -(-pairs // PAIRS)), "chunk_id")
    met = dealt.join(asks.select("query_id", "phrase", "factor").hint(size_hint(asks)), "phrase")
    return met.groupBy("query_id", "chunk_id", *about).agg(F.sum(F.col("factor") * F.col("weight")).alias("sum"))


def bm25_scores(queries: DataFrame, chunks: DataFrame, about: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, score for every chunk that holds a phrase of the query, with the chunk's columns ``about``."""
    asks, weights = bm25_parts(queries, chunks, about)
    return _sums(stage(asks, "asks"), weights, about).select("query_id", "chunk_id", *about, (-F.col("sum")).alias("score"))


def layer_filter(chunks: DataFrame, layers: list[str] | None) -> DataFrame:
    """Active chunks of the layers; no layers mean all."""
    active = chunks.where("is_active")
    return active.where(F.col("layer").isin(layers)) if layers else active


def top_by(scores: DataFrame, value: str, k: int, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k lowest rounded values of each query with their rank from 1; ties by id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round(value, 9), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


SLACK = 1e-7  # beyond what sums in another order, and ranks by rounded scores, can differ


def reached(rows: DataFrame, by: str, value: str, n: int, steps: int) -> DataFrame:
    """by, most (the largest value), least: a value that ``n`` rows reach at least, 0 where there are fewer. Rows are counted
    by steps of the value, which needs no order of all rows; least is less than a step below the n-th largest."""
    counts = rows.groupBy(by, F.floor(F.col(value) * steps).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    falling = Window.partitionBy(by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("above", F.sum("n").over(falling))
    return counts.groupBy(by).agg(F.max("high").alias("most"), F.coalesce(F.max(F.when(F.col("above") >= n, F.col("low"))), F.lit(0.0)).alias("least"))


def split_phrases(asks: DataFrame, weights: DataFrame, pool: int) -> DataFrame:
    """The asks with ``spare``, ``floor`` and ``rest``. At least ``pool`` chunks score ``floor`` or more for the query: as many
    have that much from one of its phrases alone. Phrases are spare as long as all of them together, the weakest first,
    give a chunk less than that; ``rest`` is the most that the query's spare phrases give together. So a chunk that
    holds spare phrases only is not among the first ``pool``."""
    best = reached(weights, "phrase", "weight", pool, 64)
    known = asks.hint("shuffle_merge").join(best, "phrase").select("query_id", "phrase", "factor", "df", "n_chunks", (F.col("factor") * F.col("most")).alias("most"), (F.col("factor") * F.col("least")).alias("least"))
    whole = Window.partitionBy("query_id")
    rising = whole.orderBy("most", "phrase").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("floor", F.max("least").over(whole)).withColumn("sum", F.sum("most").over(rising))
    known = known.withColumn("spare", F.col("sum") < F.col("floor") - SLACK)
    rest = F.coalesce(F.max(F.when(F.col("spare"), F.col("sum"))).over(whole), F.lit(0.0))
    return known.withColumn("rest", rest).select("query_id", "phrase", "factor", "df", "n_chunks", "spare", "floor", "rest")


def bm25_best(asks: DataFrame, weights: DataFrame, pool: int) -> DataFrame:
    """query_id, chunk_id, score of all chunks that can be among the first ``pool`` of their query, with whole scores.
    Spare phrases, mostly the common ones, are looked up for chunks alone that the other phrases leave in the race."""
    parted = stage(split_phrases(asks, weights, pool), "parted")
    sums = _sums(parted.where("NOT spare"), weights).withColumnRenamed("sum", "main")
    spare = parted.where("spare").select("query_id", "phrase", "factor")
    if spare.isEmpty():
        return sums.select("query_id", "chunk_id", (-F.col("main")).alias("score"))
    sums = stage(sums, "sums")
    bounds = parted.groupBy("query_id").agg(F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    bounds = bounds.hint("shuffle_merge").join(reached(sums, "query_id", "main", pool, 16), "query_id").select("query_id", (F.greatest("floor", "least") - F.col("rest") - SLACK).alias("bar"))
    bounds = stage(bounds, "bounds")
    racing = sums.join(bounds.hint(size_hint(bounds)), "query_id").where("main > bar")
    racing = stage(racing.select("query_id", "chunk_id", "main"), "racing")
    asked = racing.join(spare.hint(size_hint(spare)), "query_id")
    more = asked.hint("shuffle_merge").join(weights, ["chunk_id", "phrase"]).select("query_id", "chunk_id", (F.col("factor") * F.col("weight")).alias("part"))
    every = racing.select("query_id", "chunk_id", F.col("main").alias("part")).unionByName(more)
    return every.groupBy("query_id", "chunk_id").agg((-F.sum("part")).alias("score"))


def bm25_search(queries: DataFrame, chunks: DataFrame, layers: list[str] | None = None, pool: int = 20) -> DataFrame:
    """query_id, chunk_id, score, rank: the ``pool`` best chunks of the layers for each query."""
    kept = F.col("is_active") & F.col("layer").isin(layers) if layers else F.col("is_active")
    asks, weights = bm25_parts(queries, chunks.select("chunk_id", "content", F.coalesce(kept & F.col("chunk_id").isNotNull(), F.lit(False)).alias("kept")), ("kept",))
    return top_by(bm25_best(asks, weights.where("kept").drop("kept"), pool), "score", pool)
