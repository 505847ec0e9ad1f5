"""Line deduplication: a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is the sequence of the IDs of its non-blank lines. A repeated run of lines counts from
``min_words`` words on, and every line of its later copies is deleted; the first copy stays. The lines of
maximal repeated runs are exactly those covered by a shortest run of ``min_words`` words, from some line
forwards or backwards, that stands in the text before; so suffixes are only sorted as deep as such a run is
long (at most ``min_words`` lines), and the intervals of suffixes that share the run are found at that depth.

Prefix doubling: rank 0 is the line ID; the rank of 2 ** (k + 1) lines is the place of the pair of ranks of
its halves in the sorted pairs (a range-partitioned sort, numbered by partition). Suffixes that are alone
with their rank are settled and leave. A run of m lines, 2 ** k <= m, is named by the ranks of its first and
last 2 ** k lines: equal names are one interval of suffixes with a common prefix of m lines.

Order: smaller doc_id first (null last), then the row's text hash, then the line. Rows that repeat both
doc_id and text are one document. Null text stays null, blank lines and line ends stay as they are; a
document whose lines all go keeps an empty text. Empty tables give empty results. Very long texts are read whole;
extra columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.llm.common import BROADCAST_ROWS, discard, field_hash, field_span, fresh_name, list_column, prefix_hash, separators, slices_by_bytes, span_hash, spread_join, text_buffers, tidy, word_spans, write_out

NEWLINE = separators((0x0A, 0x0A))
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
CHUNK = 1 << 20
KEY = ["doc_id", "rid", "no_id"]  # never null, as the joins are by equality
NO_ID = 2**63 - 1


def _row_key(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("bigint")
    return documents.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("rid"), doc_id.isNull().alias("no_id"), text.alias("text"))


def _runs(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest runs of ``least`` words from each line forwards and backwards: text, first line in it, lines."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + least)  # one past the last line
    ok = stop <= first[1:][doc]
    a, b = line[ok], stop[ok]
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    ok = (total[1:] >= least) & (start >= first[:-1][doc])
    start, stop = np.concatenate([a, start[ok]]), np.concatenate([b, line[ok] + 1])
    both = np.unique(start * (n + 1) + stop)
    start, stop = both // (n + 1), both % (n + 1)
    return doc[start], start - first[:-1][doc[start]], stop - start


def line_sequences(documents: DataFrame, min_words: int) -> DataFrame:
    """doc_id, rid, no_id, ids (of the non-blank lines), starts and sizes (of the shortest runs of min_words words), and
    for runs of a single line a second hash of it as check: such a run is named by both."""

    def scan(batches):
        for whole in tidy(batches):
            for at, n in slices_by_bytes(whole.column(3), CHUNK):
                data, offs = text_buffers(whole.column(3).slice(at, n))
                w, _, _ = word_spans(data, offs, SPACE)
                s, e, _ = word_spans(data, offs, NEWLINE)
                inside = np.searchsorted(w, e) - np.searchsorted(w, s)
                s, e, inside = s[inside > 0], e[inside > 0], inside[inside > 0]
                first = np.searchsorted(s, offs)
                ids = field_span(field_hash(data), s, e).view(np.int64)
                doc, start, size = _runs(inside, first, min_words)
                per = np.bincount(doc, minlength=n)
                line = first[doc] + start
                check = np.where(size == 1, span_hash(prefix_hash(data), s[line], e[line]).view(np.int64), 0)
                yield pa.RecordBatch.from_arrays(
                    [*(whole.column(k).slice(at, n) for k in range(3)), list_column(ids, np.diff(first), pa.int64()), list_column(start, per, pa.int32()), list_column(size, per, pa.int32()), list_column(check, per, pa.int64())],
                    names=[*KEY, "ids", "starts", "sizes", "checks"],
                )

    schema = "doc_id bigint, rid bigint, no_id boolean, ids array<bigint>, starts array<int>, sizes array<int>, checks array<bigint>"
    return _row_key(documents).mapInArrow(scan, schema).dropDuplicates(KEY)


def sorted_ranks(pairs: DataFrame) -> DataFrame:
    """a, b, n, rank: the place of each distinct pair in the order of all, by a range-partitioned sort."""

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * m, type=pa.int32()), pa.array(np.arange(n, n + m))], names=["a", "b", "n", "part", "at"])
            n += m

    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = write_out(
        pairs.repartitionByRange(spread, "a", "b").sortWithinPartitions("a", "b").mapInArrow(number, "a bigint, b bigint, n bigint, part int, at bigint"), "ranks"
    )
    # One row for each partition of the sort: a broadcast of bounded size, whatever the number of pairs.
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0).cast("bigint")).alias("before"))
    return placed.join(F.broadcast(offsets), "part").select("a", "b", "n", (F.col("before") + F.col("at")).alias("rank"))


def later_copies(sequences: DataFrame) -> DataFrame:
    """doc_id, rid, no_id, start, size: the shortest runs that stand in the text before."""
    runs = sequences.select(*KEY, "ids", F.explode(F.arrays_zip("starts", "sizes", "checks")).alias("run")).select(
        *KEY, F.col("run.starts").alias("start"), F.col("run.sizes").alias("size"), F.expr("ids[run.starts]").alias("a"), F.col("run.checks").alias("b")
    )
    seen = sequences.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = write_out(seen, "lines")
    named = [runs.where("size = 1").select(*KEY, "start", "size", "a", "b")]
    longer = runs.where("size > 1").drop("a", "b")
    deepest = longer.agg(F.max("size")).first()[0] or 1
    if deepest > 1:
        # Only lines of runs of several lines need ranks beyond 0.
        need = longer.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
        lines = sequences.where(F.exists("sizes", lambda x: x > 1)).select(*KEY, F.posexplode("ids").alias("pos", "rank"))
        ranks = lines.hint("shuffle_merge").join(need, [*KEY, "pos"], "left_semi")
        ranks = write_out(spread_join(ranks, seen.withColumnRenamed("id", "rank"), ["rank"], ["doc_id", "pos"], "left_semi").select(*KEY, "pos", "rank"), "rank-0")
        k = 0
        while True:
            here = longer.where((F.col("size") >= 2**k) & (F.col("size") < 2 ** (k + 1)))
            first = ranks.select(*KEY, F.col("pos").alias("start"), F.col("rank").alias("a"))
            last = ranks.select(*KEY, F.col("pos").alias("last"), F.col("rank").alias("b"))
            with_last = here.withColumn("last", F.col("start") + F.col("size") - 2**k)
            pairs = with_last.hint("shuffle_merge").join(first, [*KEY, "start"]).hint("shuffle_merge").join(last, [*KEY, "last"])
            named.append(pairs.select(*KEY, "start", "size", "a", "b"))
            if 2 ** (k + 1) > deepest:
                break
            second = ranks.select(*KEY, (F.col("pos") - 2**k).alias("pos"), F.col("rank").alias("b"))
            doubled = write_out(ranks.withColumnRenamed("rank", "a").hint("shuffle_merge").join(second, [*KEY, "pos"]), "pairs")
            groups = doubled.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "n")
            ranked = write_out(sorted_ranks(groups), "ranked")
            ranks = write_out(spread_join(doubled, ranked, ["a", "b"], ["doc_id", "pos"]).select(*KEY, "pos", "rank"), f"rank-{k + 1}")
            k += 1
    alone = spread_join(named[0], seen.withColumnRenamed("id", "a"), ["a"], ["doc_id", "start"], "left_semi")
    every = alone.select(*KEY, "start", "size", "a", "b")
    for more in named[1:]:
        every = every.unionByName(more)
    every = write_out(every, "runs")
    place = F.struct("doc_id", "no_id", "rid", "start")
    first = every.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = spread_join(every, write_out(first, "first"), ["size", "a", "b"], ["doc_id", "start"])
    return joined.where(place > F.col("first")).select(*KEY, "start", "size")


def dedup_lines(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """The documents with later copies of repeated line runs deleted from ``text``; all other columns stay,
    and n_chars follows the text where it is a column."""
    names = documents.columns
    own = {stem: fresh_name(names, stem) for stem in ("doc", "rid", "no_id", "spans", "dead", "kept")}
    sequences = write_out(line_sequences(documents, min_words), "sequences")
    spans = later_copies(sequences).groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    spans = write_out(spans.select(F.col("doc_id").alias(own["doc"]), F.col("rid").alias(own["rid"]), F.col("no_id").alias(own["no_id"]), F.col("spans").alias(own["spans"])), "spans")
    discard(sequences)
    rows, size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(own["spans"])), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS // 25 and size <= BROADCAST_ROWS
    text = F.col("text").cast("string")
    doc_id = documents["doc_id"].cast("bigint")
    same = (F.coalesce(doc_id, F.lit(NO_ID)) == F.col(own["doc"])) & (F.xxhash64(text) == F.col(own["rid"])) & (doc_id.isNull() == F.col(own["no_id"]))
    hit = documents.join(spans.hint("broadcast" if few else "shuffle_merge"), same, "left")
    lines = F.flatten(F.transform(own["spans"], lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
    kept = _drop_lines(hit.withColumn(own["dead"], F.array_distinct(lines)), text, own["dead"], own["kept"])
    changed = F.col(own["spans"]).isNotNull()
    new = {"text": F.when(changed, F.col(own["kept"])).otherwise(text)}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.char_length(own["kept"])).otherwise(F.col("n_chars"))
    return kept.select(*[new[n].cast(documents.schema[n].dataType).alias(n) if n in new else F.col(n) for n in names])


def _drop_lines(marked: DataFrame, text, dead: str, kept_text: str) -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def without(texts, dead):
        import pandas as pd

        out = []
        for t, gone in zip(texts, dead, strict=True):
            if t is None or gone is None or len(gone) == 0:
                out.append(None)
                continue
            gone, kept, at = set(gone), [], 0
            for line in t.split("\n"):
                if line.strip(" \t\x0b\f\r"):
                    if at not in gone:
                        kept.append(line)
                    at += 1
                else:
                    kept.append(line)
            out.append("\n".join(kept))
        return pd.Series(out, dtype=object)

    return marked.withColumn(kept_text, without(F.when(F.col(dead).isNotNull(), text), F.col(dead)))
