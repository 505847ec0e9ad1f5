"""Scans, routing, policies, change detection and maintenance of the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from hybridkb.functions.text import tokens

from hybridkb.operators.chunking import chat_header
from hybridkb.operators.numbering import number_rows
from hybridkb.operators.records import CATEGORIES

SUFFIXES = (".pdf", ".md", ".markdown", ".txt", ".zip")
LAYERS = ("vessel", "shared", "community")
LAYER_ROOTS = {"shared": "shared", "vessel": "data", "community": "shared"}


def corpus_scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) files anywhere below a folder: path, suffix (in lower case, empty if there is none), length and
    modificationTime, and for kept files their content, which is read only if it is used. Files and folders whose
    names begin with a dot or an underscore are not seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("suffix", F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1))
    known = F.col("suffix").isin(*SUFFIXES)
    about = ["path", "suffix", "length", "modificationTime"]
    return files.where(known).select(*about, "content"), files.where(~known).select(*about)


def route_source_type(path: Column, text: Column) -> Column:
    """The kind of a file, by suffix, by the folders it lies in, and for .txt by its first 20 lines."""
    low = F.lower(path)
    slashed = F.concat(F.lit("/"), path)
    first = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, 20)
    chat = F.exists(first, lambda x: chat_header(x).isNotNull())
    plain = F.when(chat | F.contains(low, F.lit("whatsapp")), "whatsapp").otherwise("text")
    notes = F.when(F.contains(slashed, F.lit("/data/logs/maint/")), "maintenance_entry").when(F.contains(slashed, F.lit("/data/deviations/")), "deviation").otherwise("markdown")
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".zip"), "whatsapp").when(low.endswith(".md") | low.endswith(".markdown"), notes).when(low.endswith(".txt"), plain)


def layer_policy(layer: Column, path: Column, source_type: Column) -> Column:
    """Why a file may not enter a layer, or NULL."""
    root = F.create_map(*[F.lit(x) for kv in LAYER_ROOTS.items() for x in kv])[layer]
    return (
        F.when(~layer.isin(*LAYERS) | layer.isNull(), "unknown layer")
        .when(source_type.isin("maintenance_entry", "deviation") & (layer != "vessel"), "vessel only")
        .when(~path.startswith(F.concat(root, F.lit("/"))), "outside the layer's folder")
    )


def detect_changes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The incoming rows with ``status``: no-op, changed or new, by (layer, path) and content_hash."""
    old = stored.select("layer", "path", F.col("content_hash").alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("content_hash"), "no-op").otherwise("changed")
    return incoming.join(old, ["layer", "path"], "left").withColumn("status", status).drop("_old")


def upsert_source(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored rows without those that changed, and the new and changed ones. On files, write the result
    beside the old table and swap."""
    fresh = detect_changes(incoming, stored).where("status <> 'no-op'").drop("status")
    return stored.join(fresh.select("layer", "path"), ["layer", "path"], "left_anti").unionByName(fresh)


def assign_ordinals(chunks: DataFrame, source: str, *order: str) -> DataFrame:
    """A 0-based ordinal for each source; a source of any size is numbered by many tasks."""
    return number_rows(chunks, [source], list(order), "ordinal")


def relayer(sources: DataFrame, names: DataFrame) -> DataFrame:
    """Named sources of the vessel layer move to the community layer; others stay. Moving twice does nothing."""
    named = names.select(F.col("path").alias("_p")).distinct()
    joined = sources.join(named, sources["path"] == named["_p"], "left")
    moves = F.col("_p").isNotNull() & (F.col("layer") == "vessel")
    return joined.withColumn("layer", F.when(moves, "community").otherwise(F.col("layer"))).drop("_p")


def relayer_candidates(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, path, n_chunks of the vessel layer's chats; sources without chunks stay in the list."""
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    chats = sources.where("layer = 'vessel' AND source_type = 'whatsapp'")
    return chats.hint("shuffle_merge").join(counts, "source_id", "left").select("source_id", "path", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def delete_cascade(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose parent was not deleted."""
    return rows.hint("shuffle_merge").join(deleted.select(key).distinct(), key, "left_anti")


def set_null(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The rows with ``key`` NULL where the parent was deleted."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return rows.join(gone, rows[key] == gone["_gone"], "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def list_sources(sources: DataFrame, layer: str = "all") -> DataFrame:
    """Sources of a layer by id, or of all in the order of LAYERS; an unknown layer gives none."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    kept = sources if layer == "all" else sources.where(F.col("layer") == layer)
    return kept.where(rank > 0).withColumn("layer_rank", rank.cast("int")).orderBy("layer_rank", "source_id")


def explore_groups(sources: DataFrame) -> DataFrame:
    """layer_rank, layer, n_sources, first_path of the layers that have sources."""
    return list_sources(sources).groupBy("layer_rank", "layer").agg(F.count(F.lit(1)).alias("n_sources"), F.min("path").alias("first_path"))


def integrity_audit(sources: DataFrame, chunks: DataFrame, vectors: DataFrame, stored_chunks: DataFrame, zones: DataFrame, slots: DataFrame, items: DataFrame) -> DataFrame:
    """rule, item, n of all violations: repeated source paths in a layer, chunk ordinals in a source, zone names and slots
    in a zone; unknown layers and categories; chunks, vectors and items that name a source, chunk or zone that is not
    there. A missing (null) name refers to nothing and violates nothing, but a source needs a layer.

    Each table is read once: every row says which names it uses and which it defines, and one aggregation over all
    names tells what is used twice, used against the list, or used without being defined."""

    def says(rows: DataFrame, *facts: tuple[str, Column, Column, Column]) -> DataFrame:
        lists = [F.struct(F.lit(rule).alias("rule"), item.cast("string").alias("item"), uses.cast("bigint").alias("uses"), defines.cast("bigint").alias("defines")) for rule, item, uses, defines in facts]
        return rows.select(F.explode(F.array(*lists)).alias("f")).select("f.*")

    yes, no = F.lit(1), F.lit(0)
    joined = lambda *c: F.concat_ws("|", *c)
    known = lambda c, values: F.coalesce(F.lower(c).isin(*values), F.lit(False))
    category = F.col("category")
    every = [
        says(sources, ("source path", joined("layer", "path"), yes, no), ("source layer", F.coalesce("layer", F.lit("")), (~known(F.col("layer"), LAYERS)).cast("int"), no), ("chunk source", F.col("source_id"), no, yes)),
        says(chunks, ("chunk ordinal", joined("source_id", "ordinal"), yes, no), ("chunk source", F.col("source_id"), yes, no)),
        says(vectors, ("vector chunk", F.col("chunk_id"), yes, no)),
        says(stored_chunks, ("vector chunk", F.col("chunk_id"), no, yes)),
        says(zones, ("zone name", F.col("name"), yes, no), ("item zone", F.col("zone_id"), no, yes)),
        says(slots, ("zone slot", joined("zone_id", "row", "col"), yes, no)),
        says(items, ("item category", category, (~known(category, CATEGORIES)).cast("int"), no), ("item zone", F.col("zone_id"), yes, no)),
    ]
    facts = reduce(DataFrame.unionByName, every).where("item IS NOT NULL")
    counts = facts.groupBy("rule", "item").agg(F.sum("uses").alias("n"), F.max("defines").alias("defined"))
    once, listed = F.col("rule").isin("source path", "chunk ordinal", "zone name", "zone slot"), F.col("rule").isin("source layer", "item category")
    wrong = F.when(once, F.col("n") > 1).when(listed, F.col("n") > 0).otherwise((F.col("n") > 0) & (F.col("defined") == 0))
    return counts.where(wrong).select("rule", "item", "n")


SCORED = 64  # texts that a scorer gets at once


def embed_attach(chunks: DataFrame, scorer, dimension: int) -> DataFrame:
    """The chunks with ``embedding``: ``scorer`` takes a list of at most 64 texts (null as empty) and returns as many
    vectors of ``dimension`` numbers; anything else fails the job."""
    at = chunks.columns.index("content")

    def attach(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, SCORED):
                part = batch.slice(lo, SCORED)
                texts = [t or "" for t in part.column(at).to_pylist()]
                got = scorer(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                if any(len(v) != dimension for v in got):
                    raise ValueError(f"a vector has another dimension than {dimension}")
                flat = pa.array(np.asarray(got, dtype=np.float32).reshape(-1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * dimension), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, "embedding"])

    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return chunks.mapInArrow(attach, schema)


def hashed_embedding(chunks: DataFrame, dimension: int = 384) -> DataFrame:
    """The chunks with ``embedding``: counts of their tokens hashed to ``dimension`` places, of length one. It stands in
    where no model is at hand and knows words, not meanings. A text without tokens has the zero vector."""
    lists = chunks.withColumn("_tokens", tokens(F.coalesce("content", F.lit(""))))
    hashed = HashingTF(numFeatures=dimension, inputCol="_tokens", outputCol="_counts").transform(lists)
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(hashed)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def quarantine(files: DataFrame, stored: DataFrame, error: Column) -> DataFrame:
    """path, result, error for files (layer, path, content_hash and what ``error`` reads): FAIL where ``error`` is
    not NULL, NO-OP where nothing changed, else OK. A bad file never keeps another from its result."""
    judged = detect_changes(files, stored).withColumn("error", error)
    result = F.when(F.col("error").isNotNull(), "FAIL").when(F.col("status") == "no-op", "NO-OP").otherwise("OK")
    return judged.select("path", result.alias("result"), "error")


def touch_updated(incoming: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """The incoming rows with ``updated_at``: what is stored where the content is the same, else ``now``."""
    old = stored.select("layer", "path", F.col("updated_at").alias("_was"))
    judged = detect_changes(incoming, stored).join(old, ["layer", "path"], "left")
    return judged.withColumn("updated_at", F.when(F.col("status") == "no-op", F.col("_was")).otherwise(now)).drop("_was", "status")
