"""Prompt context, citations and request checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.sources.staging import size_hint, stage

LAYERS = ("shared", "vessel", "community", "all")


def chunk_metadata(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with what is shown of them, in order; unknown ids drop out. The title falls back to the source."""
    have = set(chunks.columns)
    cols = [F.col("source").alias("title") if "title" not in have else F.coalesce("title", "source").alias("title")]
    cols += [F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in ("page_start", "page_end")]
    ranked = stage(ranked, "ranked")
    return chunks.select("chunk_id", "layer", *cols, "content").join(ranked.hint(size_hint(ranked, "note")), "chunk_id").select("query_id", "pos", "chunk_id", "layer", "title", "page_start", "page_end", "content", "note")


def context_blocks(cited: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, message: the numbered chunks of each query and its question."""
    page = F.when(F.col("page_start").isNotNull(), F.concat(F.lit(", p."), F.col("page_start").cast("string"))).otherwise("")
    block = F.concat(F.lit("\n["), F.col("pos").cast("string"), F.lit("] "), "layer", F.lit(": "), "title", page, "note", F.lit("\n"), "content")
    body = cited.withColumn("block", block).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("blocks"))
    head = F.concat(F.lit("Context chunks (cite these as [1]–["), F.col("n").cast("string"), F.lit("]):\n"))
    return body.join(queries.select("query_id", "text"), "query_id").select("query_id", F.concat(head, F.array_join("blocks.block", "\n"), F.lit("\n\nQuestion: "), "text").alias("message"))


def citation_block(cited: DataFrame) -> DataFrame:
    """query_id, block: the sources of each query, one line each."""
    a, b = F.col("page_start"), F.col("page_end")
    page = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(F.lit(", p."), a.cast("string"), F.lit("–"), b.cast("string"))).when(a.isNotNull(), F.concat(F.lit(", p."), a.cast("string"))).otherwise("")
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), "layer", F.lit(": "), "title", page, "note")
    lines = cited.withColumn("line", line).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return lines.select("query_id", F.concat(F.lit("\n---\nSources:\n"), F.array_join("lines.line", "\n")).alias("block"))


def source_cards(cited: DataFrame) -> DataFrame:
    pages = F.when(F.col("page_start").isNotNull(), F.concat_ws("–", "page_start", F.when(F.col("page_end") != F.col("page_start"), F.col("page_end"))))
    return cited.select("query_id", F.col("pos").alias("n"), "layer", "title", pages.alias("pages"), "content")


def validate_citations(answers: DataFrame, n_chunks: int) -> DataFrame:
    """query_id, invalid: the markers of each answer outside 1..n_chunks, repeats kept."""
    found = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    return answers.select("query_id", F.filter(found, lambda n: (n < 1) | (n > n_chunks)).alias("invalid"))


def query_valid(requests: DataFrame) -> DataFrame:
    """The requests with a reject_reason, NULL for valid ones."""
    reason = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "blank question").when(~F.col("layer").isin(*LAYERS), "unknown layer").when(F.col("top_k") < 1, "top_k below 1")
    return requests.withColumn("reject_reason", reason)
