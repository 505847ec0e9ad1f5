"""Queries of cleaned payloads, photo captures and highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.operators import chunking, pages, payloads, records
from hybridkb.plans.chunking import SENTENCES, TOKENS, pack_sql, words_sql
from hybridkb.plans.records import _items
from hybridkb.plans.tables import table


def _case(column, n, *values):
    """values[column % n], with NULL for a missing one."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(column) % n + 1).cast("int"))


def maintenance(s, d):
    e = table(s, d, "events")
    json = F.concat(F.lit('{"system": '), _case("event_id", 3, '"Sails"', "[1]", "null"), F.lit(', "vendor": '), _case("event_id", 4, '"Acme"', '" "', "{}", "7"), F.lit(', "cost_amount": '), _case("event_id", 3, '"x"', "12.5", "null"), F.lit(', "parts": '), _case("event_id", 4, '["a", " ", "b"]', '"one"', "5", "[]"), F.lit("}"))
    r = e.select("event_id", payloads.sanitise_maintenance(json).alias("r"))
    return r.select("event_id", "r.system", "r.vendor", "r.cost_amount", F.array_join("r.parts", "|").alias("parts"))


def deviation(s, d):
    e = table(s, d, "events")
    json = F.concat(F.lit('{"component": '), _case("event_id", 3, '"Mast"', "[]", '""'), F.lit(', "reason": '), _case("event_id", 2, '" worn "', "{}"), F.lit("}"))
    return e.select("event_id", payloads.sanitise_deviation(json).alias("r")).select("event_id", "r.component", "r.reason", "r.notes")


def zone_desc(s, d):
    e = table(s, d, "events")
    json = _case("event_id", 4, '{"vertical_desc": "low"}', '{"vertical_desc": 3}', "{}", "nothing")
    return e.select("event_id", payloads.sanitise_zone_desc(json).alias("vertical_desc"))


def _detections(s, d):
    e = table(s, d, "events")
    json = F.concat(
        F.lit('{"item": '), _case("event_id", 3, '"Shackle"', '""', "[1]"), F.lit(', "brand": "B", "category": '), _case("event_id", 4, '"Flares"', '"Tool"', '"Rope"', "null"), F.lit(', "marine": true, "key_properties": '), _case("event_id", 3, '["red", " "]', '"x"', "7"),
        F.lit(', "zone_reasoning": '), _case("event_id", 2, '"seen there"', "null"), F.lit(', "suggested_zone": "Z'), (F.col("event_id") % 9).cast("string"), F.lit('", "confidence": '), (F.floor(F.col("value") * 25) / 1000).cast("string"), F.lit("}"),
    )
    zones = table(s, d, "supplier").select(F.concat(F.lit("Z"), (F.col("s_suppkey") % 5).cast("string")).alias("name"))
    return payloads.normalise_detection(e.select("event_id", json.alias("payload")), zones, F.lit("local"))


def detection(s, d):
    lists = [F.array_join(c, "|").alias(c) for c in ("key_properties", "other_items")]
    return _detections(s, d).select("event_id", "item", "brand", "model", "category", "marine", "legible", *lists, "suggested_zone", "zone_id", "zone_reasoning", F.round("confidence", 3).alias("confidence"), "low_confidence", "source")


def capture(s, d):
    return payloads.capture_to_item(_detections(s, d)).select("event_id", "name", F.col("stored_category").alias("category"), "zone_id", "brand", "model", "notes")


def notes(s, d):
    p = table(s, d, "part")
    text = payloads.capture_notes(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.split("p_name", " ")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")))
    return p.select("p_partkey", text.alias("notes"))


def highlights(s, d):
    e = table(s, d, "events")
    kept = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 500).alias("item_id"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 70).alias("deviation_id"))
    items = _items(s, d).select(F.col("p_partkey").alias("item_id"), "zone_id")
    faults = table(s, d, "customer").select(F.col("c_custkey").alias("deviation_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("bigint")).alias("zone_id"))
    return records.phrase_highlights(kept, items, faults)


def deviation_chunk(s, d):
    p = table(s, d, "part")
    text = F.concat(F.lit("---\ndeviation_id: "), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).otherwise("none"), F.lit("\nzone_id: "), F.when(F.col("p_partkey") % 2 > 0, F.col("p_size").cast("string")).otherwise("null"), F.lit("\n---\n"), "p_name")
    return chunking.deviation_chunk(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


def chat_name(s, d):
    c = table(s, d, "conversations")
    path = F.concat(F.lit("data/chats/"), F.when(F.col("turn") % 2 == 0, F.lit("WhatsApp Chat with ")).otherwise(""), "role", F.lit(" no. "), F.col("conv_id").cast("string"), F.when(F.col("turn") % 3 > 0, F.lit(".zip")).otherwise(".txt"))
    return c.select("conv_id", "turn", chunking.chat_name(path).alias("chat_name"))


def _pages(s, d):
    """Pages of twelve lines, and contents with an entry on every third page."""
    lines = table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    page = lines.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 12).cast("int"))).alias("page"))
    page = page.select("doc_id", "page", F.array_join(F.slice("l", F.col("page") * 12 + 1, F.lit(12)), "\n").alias("text"), (F.col("doc_id") % 3).alias("n_images"))
    toc = page.where("page % 3 = 1").select("doc_id", F.col("page").alias("seq"), F.when(F.col("page") % 2 == 1, 1).otherwise(2).alias("level"), F.concat(F.lit("T"), F.col("page").cast("string")).alias("title"), "page")
    return page, toc


def toc_chunks(s, d):
    return pages.toc_chunks(*_pages(s, d)).select("doc_id", "page_start", "page_end", "section_path", F.sha2("content", 256).alias("content_sha256"))


def finalised(s, d):
    return pages.finalise_chunks(pages.toc_chunks(*_pages(s, d))).select("doc_id", "section_path", "page_start", "section_ordinal", "token_count", F.sha2("content", 256).alias("content_sha256"))


def capped(s, d):
    return chunking.token_cap(table(s, d, "documents").select("doc_id", chunking.pack_sentences(F.col("text"), 120).alias("parts")), 120)


PAGES_SQL = "l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), page AS (SELECT doc_id, p, array_to_string(l[12 * p + 1:12 * p + 12], chr(10)) AS text, doc_id % 3 AS n_images FROM (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 12 + 1)) AS p FROM l))"
PATH_SQL = "CASE WHEN p < 1 THEN 'Page ' || p WHEN (p - (p - 1) % 3) % 2 = 1 THEN 'T' || (p - (p - 1) % 3) ELSE 'T' || (p - (p - 1) % 3 - 3) || ' > T' || (p - (p - 1) % 3) END"
DETECTED = """x AS (SELECT event_id, ['Shackle', NULL, NULL][event_id % 3 + 1] AS item, ['Flares', 'Tool', 'Rope', NULL][event_id % 4 + 1] AS category, ['red', 'x', ''][event_id % 3 + 1] AS properties,
  CASE WHEN event_id % 9 < 5 THEN 'Z' || event_id % 9 END AS zone, CASE WHEN event_id % 2 = 0 THEN 'seen there' END AS reasoning, floor(value * 25) / 1000 AS c FROM events)"""


def entries() -> dict:
    """key: (query, SQL or None)."""
    return {
        "sanitise_maintenance": (
            maintenance,
            "SELECT event_id, ['sails', 'other', 'other'][event_id % 3 + 1] AS system, ['Acme', NULL, NULL, '7'][event_id % 4 + 1] AS vendor, CASE WHEN event_id % 3 = 1 THEN 12.5::DOUBLE END AS cost_amount, ['a|b', 'one', '', ''][event_id % 4 + 1] AS parts FROM events",
        ),
        "sanitise_deviation": (deviation, "SELECT event_id, ['Mast', 'other', 'other'][event_id % 3 + 1] AS component, CASE WHEN event_id % 2 = 0 THEN 'worn' END AS reason, CAST(NULL AS VARCHAR) AS notes FROM events"),
        "sanitise_zone_desc": (zone_desc, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'low' ELSE '' END AS vertical_desc FROM events"),
        "normalise_detection": (
            detection,
            f"WITH {DETECTED} SELECT event_id, item, 'B' AS brand, CAST(NULL AS VARCHAR) AS model, category, true AS marine, CAST(NULL AS BOOLEAN) AS legible, properties AS key_properties, '' AS other_items, zone AS suggested_zone, zone AS zone_id, reasoning AS zone_reasoning, "
            "greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) AS confidence, c < 0.7 OR c > 1 OR zone IS NULL AS low_confidence, 'local' AS source FROM x",
        ),
        "capture_to_item": (
            capture,
            f"WITH {DETECTED} SELECT event_id, coalesce(item, 'Unknown item') AS name, CASE category WHEN 'Flares' THEN 'safety' WHEN 'Tool' THEN 'tool' ELSE 'spare' END AS category, zone AS zone_id, 'B' AS brand, CAST(NULL AS VARCHAR) AS model, "
            "nullif(concat_ws('; ', CASE category WHEN 'Flares' THEN 'Vision category: Flares (stored as safety)' WHEN 'Rope' THEN 'Vision category: Rope (stored as spare)' END, CASE WHEN properties <> '' THEN 'Properties: ' || properties END, reasoning), '') AS notes FROM x",
        ),
        "capture_notes": (notes, "SELECT p_partkey, concat_ws('; ', 'Vision category: ' || p_type || ' (stored as spare)', CASE WHEN p_size % 2 = 0 THEN 'Properties: ' || replace(p_name, ' ', ', ') END, CASE WHEN p_size % 3 = 0 THEN p_brand END) AS notes FROM part"),
        "phrase_highlights": (
            highlights,
            "WITH i AS (SELECT l_partkey AS id, min(l_suppkey) AS zone_id FROM lineitem GROUP BY 1), h AS (SELECT user_id AS query_id, event_id AS pos, zone_id, 'inventory' AS kind FROM events JOIN i ON event_id % 3 = 0 AND id = event_id % 500 JOIN part ON p_partkey = id "
            "UNION ALL SELECT user_id, event_id, c_nationkey, 'deviation' FROM events JOIN customer ON event_id % 5 = 0 AND c_custkey = event_id % 70 AND c_custkey % 4 > 0) SELECT query_id, zone_id, min(pos) AS first_rank, CASE WHEN bool_or(kind = 'deviation') THEN 'deviation' ELSE 'inventory' END AS kind FROM h GROUP BY ALL",
        ),
        "deviation_chunk": (
            deviation_chunk,
            "SELECT p_partkey AS doc_id, 'Factory Deviation' AS section_path, p_name AS content, 0 AS section_ordinal, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS token_count, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS INTEGER) AS deviation_id, CAST(CASE WHEN p_partkey % 2 > 0 THEN p_size END AS INTEGER) AS zone_id FROM part",
        ),
        "chat_name": (chat_name, "SELECT conv_id, turn, role || ' no. ' || conv_id AS chat_name FROM conversations"),
        "image_pages": (lambda s, d: pages.image_pages(_pages(s, d)[0]).select("doc_id", "page"), f"WITH {PAGES_SQL} SELECT doc_id, CAST(p AS INTEGER) AS page FROM page WHERE length(trim(text)) < 10 AND n_images >= 1"),
        "toc_section": (lambda s, d: pages.toc_section(*_pages(s, d)).select("doc_id", "page", "section_path"), f"WITH {PAGES_SQL} SELECT doc_id, CAST(p AS INTEGER) AS page, {PATH_SQL} AS section_path FROM page"),
        "toc_chunks": (
            toc_chunks,
            rf"WITH {PAGES_SQL}, c AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM page) SELECT doc_id, CAST(p AS INTEGER) AS page_start, CAST(p AS INTEGER) AS page_end, {PATH_SQL} AS section_path, sha256(content) AS content_sha256 FROM c WHERE content <> ''",
        ),
        "finalise_chunks": (
            finalised,
            rf"""WITH RECURSIVE {PAGES_SQL}, c AS (SELECT doc_id, p AS page_start, {PATH_SQL} AS section_path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM page),
            raw AS (SELECT * FROM c WHERE x <> ''), {words_sql('pack', 'raw', 'doc_id, section_path, page_start')}
            SELECT doc_id, section_path, CAST(page_start AS INTEGER) AS page_start, CAST(row_number() OVER (PARTITION BY doc_id, section_path ORDER BY page_start, part) - 1 AS INTEGER) AS section_ordinal, CAST({TOKENS.format('content')} AS INTEGER) AS token_count, sha256(content) AS content_sha256 FROM pack""",
        ),
        "token_cap": (
            capped,
            f"""WITH RECURSIVE doc AS (SELECT doc_id, {SENTENCES.format('text')} AS l FROM documents), {pack_sql('pack', 'doc', 'doc_id', 120)}, size AS (SELECT doc_id, n, {TOKENS.format('content')} AS tokens FROM pack)
            SELECT doc.doc_id, CAST(count(n) AS INTEGER) AS n_parts, CAST(count_if(tokens > 120 AND n > 1) AS INTEGER) AS n_over, CAST(coalesce(max(tokens), 0) AS INTEGER) AS largest FROM doc LEFT JOIN size USING (doc_id) GROUP BY doc.doc_id""",
        ),
    }
