"""Queries of the builders and of item lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.operators import builders as b
from hybridkb.plans import tables
from hybridkb.plans.tables import WHOLE_SQL, table
from hybridkb.sources import versions
from hybridkb.sources.staging import fresh_folder


def _zones(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("zone_id"), F.col("s_name").alias("name"))


def zones(s, d):
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey") % 700)
    new = c.select(F.col("c_custkey").alias("row_no"), F.when(F.col("k") < 50, F.concat(F.lit("Supplier#"), F.lpad(F.col("k").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Z"), F.col("k").cast("string"))).alias("name"), F.when(F.col("k") % 2 == 0, F.lit("given")).alias("description"), F.lit("made").alias("generated"))
    return b.build_zones(new, _zones(s, d)).select("row_no", "name", "description", "reject_reason")


def deviations(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(" ").alias("component"), F.col("p_type").alias("factory_spec"), F.lit(None).cast("string").alias("as_built"), F.when(F.col("p_size") % 3 > 0, F.col("p_partkey") * 2).alias("zone_id"))
    return b.build_deviations(p, _zones(s, d)).select("p_partkey", "content", "reject_reason")


def items(s, d):
    """Customers as items of nations' grids; the batch is written and read back table by table."""
    n = table(s, d, "nation")
    zones = n.where("n_nationkey % 11 <> 10").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("name"))
    slots = n.select(F.col("n_nationkey").alias("zone_id"), F.explode(F.sequence(F.lit(1), F.col("n_regionkey") + 1)).alias("row")).select("zone_id", "row", F.lit(1).alias("col"))
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(
        k.alias("item_id"), F.when(k % 17 > 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(k % 6 == 0, "boat").otherwise(" Tool").alias("category"), F.when(k % 3 == 0, F.lower("c_mktsegment")).alias("aliases"),
        F.col("c_mktsegment").alias("brand"), F.lit(None).cast("string").alias("model"), F.when(k % 2 == 0, F.lit("")).otherwise("kept dry").alias("notes"),
        F.when(k % 7 > 0, F.col("c_nationkey")).alias("zone_id"), F.when(k % 4 > 0, (k % 4).cast("int")).alias("row"), F.when(k % 4 > 0, 1).alias("col"),
    )
    path = versions.write_together(b.build_items(rows, zones, slots), fresh_folder(s, "items"), "batch-1")
    read = lambda name: s.read.parquet(f"{path}/{name}")
    good = read("items").select("item_id", "category").hint("shuffle_merge").join(read("chunks").select("item_id", "content"), "item_id").hint("shuffle_merge").join(read("sources").select("item_id", "path", "content_hash"), "item_id")
    none = F.lit(None).cast("string")
    return good.withColumn("reject_reason", none).unionByName(read("rejects").select("item_id", none.alias("category"), none.alias("content"), none.alias("path"), none.alias("content_hash"), "reject_reason"))


def written(s, d):
    e = table(s, d, "events")
    rows = e.select(F.col("event_id").alias("entry_id"), F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.col("event_type").alias("system"), F.when(F.col("event_id") % 11 > 0, F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).otherwise(" ").alias("content"))
    return b.build_entries(rows, "2026-05-30").select("entry_id", "file_name", F.sha2("text", 256).alias("text_sha256"))


def _located(s, d):
    """Questions, parts as items, and chunks of which three in a row belong to an item. Even questions name a brand."""
    chunks = tables.chunks(s, d, vectors=False).withColumn("item_id", F.floor(F.col("chunk_id") / 3))
    i = table(s, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand")
    q = tables.queries(s, d).withColumn("text", F.when(F.col("query_id") % 2 == 0, F.lit("#12")).otherwise(F.col("text")))
    return q, i, chunks


def locate(s, d):
    return b.locate_items(*_located(s, d), ["p_name", "p_brand"], vectors=tables.chunks(s, d))


def fallback(s, d):
    q, i, chunks = _located(s, d)
    return b.locate_fallback(q, q.where("text = '#12'"), i, chunks, tables.chunks(s, d))


# Retrieval over the vessel layer alone; words count over all chunks.
VESSEL_SQL = WHOLE_SQL.replace("WHERE is_active) WHERE rank <= 20", "WHERE is_active AND layer = 'vessel') WHERE rank <= 20").replace("ON is_active AND q.embedding", "ON is_active AND c.layer = 'vessel' AND q.embedding")
FALLBACK_SQL = """fallback AS (
  SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank FROM (
    SELECT query_id, chunk_id // 3 AS item_id, min(pos) AS pos FROM final JOIN gate USING (query_id) WHERE NOT gate.refused AND query_id % 2 <> 0 GROUP BY ALL)
  WHERE item_id IN (SELECT p_partkey FROM part))"""


def entries() -> dict:
    """key: (query, SQL or None)."""
    return {
        "build_zones": (
            zones,
            "WITH c AS (SELECT c_custkey AS row_no, CASE WHEN k < 50 THEN 'Supplier#' || lpad(CAST(k AS VARCHAR), 9, '0') ELSE 'Z' || k END AS name, CASE WHEN k % 2 = 0 THEN 'given' ELSE 'made' END AS description FROM (SELECT c_custkey, c_custkey % 700 AS k FROM customer)) "
            "SELECT row_no, name, description, CASE WHEN name IN (SELECT s_name FROM supplier) THEN 'zone exists' WHEN row_number() OVER (PARTITION BY name ORDER BY row_no) > 1 THEN 'repeated in the batch' END AS reject_reason FROM c",
        ),
        "build_deviations": (
            deviations,
            "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE ' ' END AS component, p_type, CASE WHEN p_size % 3 > 0 THEN p_partkey * 2 END AS zone_id FROM part), y AS (SELECT *, CASE WHEN trim(component) = '' THEN 'no component' WHEN zone_id IS NOT NULL AND s_suppkey IS NULL THEN 'unknown zone' END AS reject_reason FROM x LEFT JOIN supplier ON s_suppkey = zone_id) "
            "SELECT p_partkey, CASE WHEN reject_reason IS NULL THEN '[Deviation] ' || component || ' factory: ' || p_type || ' — ' || coalesce(s_name, 'location unknown') END AS content, reject_reason FROM y",
        ),
        "build_items": (
            items,
            """WITH x AS (SELECT *, c_custkey AS k, c_custkey % 7 > 0 AS placed, n_nationkey % 11 = 10 AS unknown FROM customer JOIN nation ON n_nationkey = c_nationkey),
            y AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'no name' WHEN k % 6 = 0 THEN 'unknown category' WHEN k % 4 > 0 AND NOT placed THEN 'slot without a zone' WHEN placed AND unknown THEN 'unknown zone'
                                 WHEN k % 4 = 0 THEN NULL WHEN k % 4 > n_regionkey + 1 THEN 'outside the grid' END AS reject_reason FROM x),
            z AS (SELECT *, '[Item] ' || c_name || ' (tool' || CASE WHEN k % 3 = 0 THEN ', ' || lower(c_mktsegment) ELSE '' END || ') ' || CASE WHEN placed THEN '— ' || n_name || CASE WHEN k % 4 > 0 THEN ', row ' || k % 4 || ', col 1' ELSE '' END ELSE '— location unknown' END
                         || ' Brand: ' || c_mktsegment || CASE WHEN k % 2 = 0 THEN '' ELSE ' kept dry' END || CASE WHEN k % 3 = 0 THEN ' Aliases: ' || lower(c_mktsegment) ELSE '' END AS text FROM y)
            SELECT k AS item_id, CASE WHEN reject_reason IS NULL THEN 'tool' END AS category, CASE WHEN reject_reason IS NULL THEN text END AS content, CASE WHEN reject_reason IS NULL THEN 'data/items/' || k END AS path,
                   CASE WHEN reject_reason IS NULL THEN sha256(text) END AS content_hash, reject_reason FROM z""",
        ),
        "build_entries": (
            written,
            """WITH x AS (SELECT event_id AS entry_id, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2026-05-30' END AS date, event_type AS system, event_type || ' ' || event_id AS content FROM events WHERE event_id % 11 > 0),
            y AS (SELECT *, date || '-' || replace(content, ' ', '-') AS base FROM x)
            SELECT entry_id, base || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END || '.md' AS file_name,
                   sha256('---' || chr(10) || 'date: ' || date || chr(10) || 'system: ' || system || chr(10) || '---' || chr(10) || content) AS text_sha256 FROM y WINDOW w AS (PARTITION BY base ORDER BY entry_id)""",
        ),
        "locate_items": (
            locate,
            f"WITH RECURSIVE {VESSEL_SQL}, {FALLBACK_SQL} SELECT query_id, item_id, rank, 'retrieval' AS how FROM fallback UNION ALL "
            "SELECT item_id, p_partkey, CAST(row_number() OVER (PARTITION BY item_id ORDER BY p_partkey) AS INTEGER), 'field' FROM benchmark JOIN part ON item_id % 2 = 0 AND (contains(lower(p_name), '#12') OR contains(lower(p_brand), '#12'))",
        ),
        "locate_fallback": (fallback, f"WITH RECURSIVE {VESSEL_SQL}, {FALLBACK_SQL} SELECT query_id, item_id, rank FROM fallback"),
    }
