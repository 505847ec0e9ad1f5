"""A corpus pipeline over ``documents``: each stage is one operator, written out and reread by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of documents, extra
ones included; the last adds the token ids as ``ids``. A stage's folder goes when the next one is written.

Null and empty texts pass every stage (they are neither toxic, nor copies, nor contaminated) and end with no
tokens; rows with a null doc_id pass the filters that work by id, but lose repeated lines. Repeated rows are
kept or dropped together, as decisions are by doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hybridkb.llm.common import delete_folder
from hybridkb.llm.decontaminate import drop_contaminated
from hybridkb.llm.line_dedup import dedup_lines
from hybridkb.llm.neardup import drop_near_duplicates
from hybridkb.llm.sentencepiece_sa import encode_documents
from hybridkb.llm.toxicity import drop_toxic
from hybridkb.sources.staging import fresh_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; all rows stay."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark windows go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay and get the token ids of their texts."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: A trained classifier and SentencePiece have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and reread."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = fresh_folder(spark, "pipeline")  # the last stage's rows go with the session
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
