"""Whole-batch builders of records, with what they reject, and item lookup with a retrieval fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.functions.text import anchor_key
from hybridkb.operators import fusion
from hybridkb.operators.records import CATEGORIES, deviation_descriptor, entry_filename, find_items, item_descriptor, render_entry, slot_valid
from hybridkb.sources.staging import size_hint, stage


def build_zones(incoming: DataFrame, zones: DataFrame) -> DataFrame:
    """The incoming zones with ``reject_reason``: a name that exists, or that an earlier row of the batch has;
    an explicit description wins over a generated one."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("row_no"))
    known = zones.select("name", F.lit(True).alias("_known")).distinct()
    rows = incoming.withColumn("_nth", nth).join(known, "name", "left")
    reason = F.when(F.col("_known"), "zone exists").when(F.col("_nth") > 1, "repeated in the batch")
    return rows.withColumn("description", F.coalesce("description", "generated")).withColumn("reject_reason", reason).drop("_nth", "_known", "generated")


def build_deviations(incoming: DataFrame, zones: DataFrame) -> DataFrame:
    """The incoming deviations with their chunk text and ``reject_reason``: a component is needed, and a zone
    that exists or none."""
    known = zones.select(F.col("zone_id").alias("_zone"), F.col("name").alias("_label"))
    rows = incoming.join(known, incoming["zone_id"] == known["_zone"], "left")
    reason = F.when(F.trim(F.coalesce("component", F.lit(""))) == "", "no component").when(F.col("zone_id").isNotNull() & F.col("_zone").isNull(), "unknown zone")
    none = F.lit(None).cast("string")
    text = deviation_descriptor(F.col("component"), F.col("factory_spec"), F.col("as_built"), none, none, F.col("_label"), none)
    return rows.withColumn("content", F.when(reason.isNull(), text)).withColumn("reject_reason", reason).drop("_zone", "_label")


def build_items(incoming: DataFrame, zones: DataFrame, slots: DataFrame) -> dict[str, DataFrame]:
    """The tables ``items``, ``sources``, ``chunks`` and ``rejects`` of a batch (item_id, name, category, aliases, brand, model,
    notes, zone_id, row, col). Name, category, zone and slot are checked before anything is built; a slot needs a zone
    and must be in its grid. An item's chunk is its descriptor, and its source row has the descriptor's hash."""
    known = zones.select(F.col("zone_id").alias("_zone"), F.col("name").alias("_label"))
    rows = slot_valid(incoming, slots).hint("shuffle_merge").join(known, F.col("zone_id") == F.col("_zone"), "left")
    category = F.lower(F.trim("category"))
    reason = (
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no name")
        .when(~F.coalesce(category.isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(F.col("row").isNotNull() & F.col("zone_id").isNull(), "slot without a zone")
        .when(F.col("zone_id").isNotNull() & F.col("_zone").isNull(), "unknown zone")
        .otherwise(F.col("reason"))
    )
    slot = F.when(F.col("row").isNotNull(), F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(", col "), F.col("col").cast("string")))
    text = item_descriptor(F.col("name"), category, F.col("aliases"), F.col("_label"), slot, F.col("brand"), F.col("model"), F.lit(None).cast("string"), F.col("notes"))
    path = F.concat(F.lit("data/items/"), F.col("item_id").cast("string"))
    judged = stage(rows.withColumn("reject_reason", reason).withColumn("_text", text).withColumn("_path", path), "items")
    good = judged.where("reject_reason IS NULL")
    return {
        "items": good.select(*[c for c in incoming.columns if c != "category"], category.alias("category")),
        "sources": good.select("item_id", F.col("_path").alias("path"), F.lit("vessel").alias("layer"), F.lit("inventory").alias("source_type"), F.sha2("_text", 256).alias("content_hash")),
        "chunks": good.select("item_id", F.col("_path").alias("path"), F.lit(0).alias("ordinal"), F.lit("Item").alias("section_path"), F.col("_text").alias("content"), anchor_key(F.col("_path"), F.lit("Item"), F.lit(0)).alias("anchor_key")),
        "rejects": judged.where("reject_reason IS NOT NULL").select(*incoming.columns, "reject_reason"),
    }


def build_entries(incoming: DataFrame, today: str) -> DataFrame:
    """Files of maintenance entries: blank text is left out, a missing date is ``today``, names are made unique."""
    kept = incoming.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("date", F.coalesce("date", F.lit(today)))
    return entry_filename(kept).withColumn("text", render_entry(["date", "system"]))


def locate_fallback(queries: DataFrame, found: DataFrame, items: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, rank for the questions that ``found`` (query_id) does not have: retrieval over the vessel layer,
    whose chunks lead back to items that exist (chunks has item_id), in rank order, each item once. A refused
    question, or one whose chunks belong to no item, has no row. ``vectors`` is that of ``retrieve``."""
    rest = stage(queries.hint("shuffle_merge").join(found.select("query_id").distinct(), "query_id", "left_anti"), "unmatched")
    hits = stage(fusion.retrieve(rest, chunks, layers=["vessel"], n=5, pool=20, vectors=vectors).where("NOT refused").select("query_id", "pos", "chunk_id"), "hits")
    led = chunks.select("chunk_id", "item_id").where("item_id IS NOT NULL").join(hits.hint(size_hint(hits)), "chunk_id").groupBy("query_id", "item_id").agg(F.min("pos").alias("pos"))
    led = led.hint("shuffle_merge").join(items.select("item_id"), "item_id", "left_semi")
    return led.select("query_id", "item_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("rank"))


def locate_items(queries: DataFrame, items: DataFrame, chunks: DataFrame, columns: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, rank, how: items whose fields hold the question; questions without any go to retrieval."""
    by_field = stage(find_items(items, queries, columns).select("query_id", "item_id"), "by-field")
    led = locate_fallback(queries, by_field, items, chunks, vectors).withColumn("how", F.lit("retrieval"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))
    return by_field.select("query_id", "item_id", nth.alias("rank"), F.lit("field").alias("how")).unionByName(led)
