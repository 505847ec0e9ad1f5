"""Exact token totals for every context limit, from a histogram of encoded lengths.

Documents are encoded whole and aggregated by length. With n(l) documents of l tokens, suffix sums over l
give, for a limit L: how many documents are longer, the tokens that truncation at L keeps,
sum of min(l, L), and what it cuts. The histogram has a row for each different length; its suffix sums are
taken in three levels, within blocks of lengths, over the blocks of a top and over the tops, so no task gets all
rows: a top stands for 65,536 lengths, and as a text has less than 2 ** 31 bytes, there are at most 32,768 tops.

Null and empty texts have 0 tokens; very long texts are encoded whole. Repeated rows count once each. An empty
table gives an empty histogram; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hybridkb.llm.common import write_out

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern published with the byte-level BPE vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 256  # lengths in a block


_encodings: dict[str, object] = {}


def _encoding(digest: str, ranks: bytes):
    """A worker's encoding of the ranks with this digest."""
    if digest not in _encodings:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[digest] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[digest]


def token_count_column(documents: DataFrame, text: str = "text", ranks_file: str = RANKS_FILE) -> Column:
    """The number of tokens of a text column. The ranks go to the workers by broadcast (about 1 MB)."""
    ranks = Path(ranks_file).read_bytes()
    digest, shared = hashlib.sha256(ranks).hexdigest(), documents.sparkSession.sparkContext.broadcast(ranks)

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(digest, shared.value).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], type=pa.int64())

    return count(F.col(text).cast("string"))


def length_histogram(documents: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """length, n_docs."""
    lengths = documents.select(token_count_column(documents, ranks_file=ranks_file).alias("length"))
    # Written out: the suffix sums read it several times, and the texts are encoded once.
    return write_out(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each different length, as a context limit: n_docs (of just this length), n_fit and n_longer
    (documents within and beyond the limit), tokens_fit (their tokens), tokens_kept (after truncation at the
    limit), tokens_cut, and share (the quantile of this length: the part of documents within the limit)."""
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    behind = Window.partitionBy(F.floor(F.col("block") / BLOCK)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # Blocks of blocks: one row for each BLOCK ** 2 lengths.
    top = blocks.groupBy(F.floor(F.col("block") / BLOCK).alias("top")).agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    every = Window.partitionBy(F.lit(0))  # 32,768 rows at most
    above = every.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    tops = top.select(
        "top", F.coalesce(F.sum("d").over(above), none).alias("d_top"), F.coalesce(F.sum("t").over(above), none).alias("t_top"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all")
    )
    zero = F.lit(0).cast("bigint")
    blocks = blocks.select("block", F.floor(F.col("block") / BLOCK).alias("top"), F.coalesce(F.sum("d").over(behind), zero).alias("d_block"), F.coalesce(F.sum("t").over(behind), zero).alias("t_block"))
    blocks = blocks.hint("shuffle_merge").join(tops, "top")
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inside), zero)).withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), zero))
    rows = rows.hint("shuffle_merge").join(blocks, "block")
    longer = F.col("d_in") + F.col("d_block") + F.col("d_top")
    beyond = F.col("t_in") + F.col("t_block") + F.col("t_top")
    kept = F.col("t_all") - beyond + longer * F.col("length")
    return rows.select(
        "length",
        "n_docs",
        (F.col("d_all") - longer).alias("n_fit"),
        longer.alias("n_longer"),
        (F.col("t_all") - beyond).alias("tokens_fit"),
        kept.alias("tokens_kept"),
        (F.col("t_all") - kept).alias("tokens_cut"),
        ((F.col("d_all") - longer) / F.col("d_all")).alias("share"),
    )


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """tokens_kept after truncation at any limit, from the row of the longest length within it."""
    best = totals.where(F.col("length") <= limit).agg(F.max(F.struct("length", "tokens_fit", "n_longer")).alias("m"), F.max("n_fit").alias("n"))
    everything = totals.agg(F.max(F.col("n_fit") + F.col("n_longer")).alias("all"))
    return best.join(F.broadcast(everything)).select((F.coalesce("m.tokens_fit", F.lit(0)) + limit * F.coalesce("m.n_longer", "all")).alias("tokens_kept"))
