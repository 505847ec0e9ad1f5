"""Queries of records and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.functions.text import item_metadata
from hybridkb.operators import records as r
from hybridkb.plans.tables import LAYERS, table
from hybridkb.sources import tables as t
from hybridkb.sources import versions
from hybridkb.sources.staging import fresh_folder, rename_suffix


LOST = 1_000_000_000_000  # added to the number of a source, names one that does not exist


def _sources(s, d, version=1):
    """A source for each document. Version 1 is what is stored: ten in a hundred lie under an older name there, and every
    fifth has been edited since."""
    docs = table(s, d, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    if version == 1:
        name = F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("old-"), name)).otherwise(name)
    path = F.concat_ws("/", F.lit("data"), "source", name)
    text = F.col("text") if version == 1 else F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("source_id"), F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.col("doc_id") % 3 + 1).cast("int")).alias("layer"), path.alias("path"), F.when(F.col("doc_id") % 4 == 0, "whatsapp").otherwise("markdown").alias("source_type"), F.sha2(text, 256).alias("content_hash"))


SRC = """src AS (SELECT doc_id AS source_id, ['shared', 'community', 'vessel'][doc_id % 3 + 1] AS layer, 'data/' || source || '/' || doc_id || '.md' AS path,
  CASE WHEN doc_id % 4 = 0 THEN 'whatsapp' ELSE 'markdown' END AS source_type, text FROM documents)"""


def _chunks(s, d):
    """A chunk for each line; those of every seventh document name a source that is not there."""
    owner = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + LOST).otherwise(F.col("doc_id"))
    return table(s, d, "documents").select(owner.alias("source_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))


def _entries(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("entry_id"), F.date_format(F.col("ts"), "yyyy-MM-dd").alias("date"), F.col("event_type").alias("system"), F.concat_ws(" ", "event_type", F.lit("by"), F.col("user_id").cast("string")).alias("content"), F.col("props").alias("metadata"))


ENT = "ent AS (SELECT event_id AS entry_id, strftime(ts, '%Y-%m-%d') AS date, event_type AS system, event_type || ' by ' || user_id AS content, props AS metadata FROM events)"


def _items(s, d):
    where = table(s, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("zone_id"))
    p = table(s, d, "part")
    return p.join(where, p["p_partkey"] == where["l_partkey"], "left").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "zone_id")


ITEMS = "items AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, zone_id FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS zone_id FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"


def _questions(s, d):
    """Names, brands and pieces of kinds of the parts, and names of nations, each asked once."""
    p = table(s, d, "part")
    texts = [p.select(F.upper("p_name").alias("text")), p.select("p_brand"), p.select(F.substring("p_type", 2, 2)), table(s, d, "nation").select("n_name")]
    every = texts[0]
    for more in texts[1:]:
        every = every.union(more)
    return every.distinct().select(F.col("text").alias("query_id"), "text")


def _zones(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("zone_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("area"), F.when(F.col("s_suppkey") % 6 > 0, F.col("s_acctbal")).alias("vertical_index"))


def entries() -> dict:
    """key: (query, SQL or None)."""
    slot = lambda: F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("row "), F.col("p_size").cast("string")))
    raw = lambda: F.element_at(F.array(*[F.lit(x) for x in ("Engine", "oil of the engine", "nav", "winch", "Hull/Deck", "x", "the rigging")]), (F.col("event_id") % 7 + 1).cast("int"))
    cat = lambda: F.element_at(F.array(*[F.lit(x) for x in ("Flares", "toolbox", "water", "games", "box of shackles", "SAFETY", "")]), (F.col("event_id") % 7 + 1).cast("int"))

    def descriptor(s, d):
        z = _zones(s, d).select("zone_id", "name")
        i = _items(s, d).join(z, "zone_id", "left")
        none = F.lit(None).cast("string")
        return i.select("p_partkey", r.item_descriptor(F.col("p_name"), F.lit("spare"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.col("name"), slot(), F.col("p_brand"), none, F.concat(F.lit("Part: "), F.col("p_partkey").cast("string")), none).alias("descriptor"))

    def deviation(s, d):
        z = _zones(s, d).select("zone_id", "name")
        i = _items(s, d).join(z, "zone_id", "left")
        none = F.lit(None).cast("string")
        return i.select("p_partkey", r.deviation_descriptor(F.col("p_name"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), none, none, F.col("name"), none).alias("descriptor"))

    def moves(s, d):
        return r.latest_moves(table(s, d, "events"), "user_id", "event_type", "event_id")

    def resolve(s, d):
        z = _zones(s, d).select("zone_id", F.regexp_replace("name", r"\d$", "").alias("name"))
        rows = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(" ")).when(F.col("s_suppkey") % 3 == 1, F.regexp_replace("s_name", r"\d$", "")).otherwise(F.lit("nowhere")).alias("zone"))
        return r.resolve_zone(rows, z, "zone")

    def slots(s, d):
        grid = table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.explode(F.sequence(F.lit(1), F.col("n_regionkey") + 1)).alias("row")).select("zone_id", "row", F.explode(F.array(F.lit(1), F.lit(2))).alias("col")).where("zone_id % 5 <> 4")
        rows = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("zone_id"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 4).cast("int")).alias("row"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 3 + 1).cast("int")).alias("col"))
        return r.slot_valid(rows, grid).select("c_custkey", "reason")

    def find(s, d):
        return r.find_items(table(s, d, "part"), _questions(s, d), ["p_name", "p_brand", "p_type"]).select("query_id", "p_partkey")

    def cascade(s, d):
        gone = _sources(s, d).where("source_id % 6 = 0")
        return t.delete_cascade(_chunks(s, d), gone, "source_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))

    def audit(s, d):
        """Tables with faults of every kind: repeated rows, unknown layers and categories, names of what is not there."""
        src = _sources(s, d, 2).withColumn("layer", F.when(F.col("source_id") % 90 == 1, "attic").otherwise(F.col("layer")))
        src = src.unionByName(_sources(s, d, 2).where("source_id % 50 = 0"))
        c = _chunks(s, d)
        c = c.unionByName(c.where(f"source_id % {LOST} % 40 = 0 AND ordinal = 0"))
        vectors = table(s, d, "embeddings").select((F.col("vec_id") * 3).alias("chunk_id"))
        zones = _zones(s, d).select("zone_id", F.regexp_replace("name", r"\d$", "").alias("name"))
        slots = table(s, d, "customer").select(F.col("c_nationkey").alias("zone_id"), (F.col("c_custkey") % 30).alias("row"), (F.col("c_custkey") % 4).alias("col"))
        things = _items(s, d).select(F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise("Spare").alias("category"), (F.col("zone_id") + 1).alias("zone_id"))
        docs = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"))
        return t.integrity_audit(src, c, vectors, docs, zones, slots, things)

    def upsert(s, d):
        """The stored sources are published, then what came in; read back from the newest version."""
        folder = fresh_folder(s, "sources")
        for version in (1, 2):
            versions.publish_changes(_sources(s, d, version), folder)
        return versions.read_table(s, folder).select("source_id", "layer", "path", "content_hash")

    def scan(s, d):
        """Documents written out as lines of JSON below a folder, in files of three kinds; what the scan keeps is read."""
        folder = fresh_folder(s, "scanned")
        kind = F.element_at(F.array(F.lit("txt"), F.lit("md"), F.lit("json")), (F.col("doc_id") % 3 + 1).cast("int"))
        rows = table(s, d, "documents").select(kind.alias("kind"), F.to_json(F.struct("doc_id", "text")).alias("line"))
        for k in ("txt", "md", "json"):
            rows.where(F.col("kind") == k).select("line").write.option("maxRecordsPerFile", 2000).text(f"{folder}/{k}/deep")
            rename_suffix(s, f"{folder}/{k}/deep", ".txt", f".{k}")
        kept, skipped = t.corpus_scan(s, folder)
        lines = kept.select("suffix", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
        docs = lines.select("suffix", F.from_json("line", "doc_id bigint, text string").alias("r")).select("r.doc_id", "suffix", F.sha2("r.text", 256).alias("text_sha256"), F.lit("kept").alias("status"))
        none = skipped.select(F.lit(None).cast("bigint").alias("doc_id"), "suffix", F.lit(None).cast("string").alias("text_sha256"), F.lit("skipped").alias("status"))
        return docs.unionByName(none.distinct())

    def vectors(s, d):
        c = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
        return t.hashed_embedding(c).select("chunk_id", "embedding")

    def sink(s, d):
        """Chunks by layer; then every second source of the vessel layer moves to the community layer."""
        folder = fresh_folder(s, "chunks")
        c = _chunks(s, d).select("source_id", "ordinal", F.sha2("content", 256).alias("content_sha256"))
        about = _sources(s, d, 2).select(F.col("source_id").alias("_id"), "layer", "path")
        own = F.when(F.col("source_id") >= LOST, F.col("source_id") - LOST).otherwise(F.col("source_id"))
        versions.publish(c.withColumn("_id", own).hint("shuffle_merge").join(about, "_id").drop("_id"), folder)
        versions.relayer_table(about.where("layer = 'vessel' AND _id % 2 = 0").select("path"), folder)
        return versions.read_table(s, folder).select("source_id", "ordinal", "layer", "version", "content_sha256")

    def nulls(s, d):
        gone = _zones(s, d).where("zone_id % 4 = 0")
        return t.set_null(_items(s, d).select("p_partkey", "zone_id"), gone, "zone_id")

    def highlights(s, d):
        e = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 11).alias("zone_id"), F.col("event_id").alias("rank"), F.when(F.col("event_type") == "error", "deviation").otherwise("inventory").alias("kind"))
        return r.zone_highlights(e)

    def route(s, d):
        p = F.concat_ws("/", F.element_at(F.array(*[F.lit(x) for x in ("data/logs/maint", "data/deviations", "shared", "data/WhatsApp")]), (F.col("doc_id") % 4 + 1).cast("int")), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".pdf")))
        layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.col("doc_id") % 3 + 1).cast("int"))
        rows = table(s, d, "documents").select("doc_id", p.alias("path"), "text", layer.alias("layer")).withColumn("source_type", t.route_source_type(F.col("path"), F.col("text")))
        return rows

    route_sql = "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'pdf' WHEN 1 THEN CASE doc_id % 4 WHEN 0 THEN 'maintenance_entry' WHEN 1 THEN 'deviation' ELSE 'markdown' END ELSE CASE WHEN doc_id % 4 = 3 THEN 'whatsapp' ELSE 'text' END END AS source_type"
    return {
        "route_source_type": (lambda s, d: route(s, d).select("doc_id", "source_type"), route_sql + " FROM documents"),
        "layer_policy": (
            lambda s, d: route(s, d).select("doc_id", t.layer_policy(F.col("layer"), F.col("path"), F.col("source_type")).alias("reject_reason")),
            f"WITH x AS ({route_sql}, ['shared', 'community', 'vessel'][doc_id % 3 + 1] AS layer FROM documents) SELECT doc_id, CASE WHEN source_type IN ('maintenance_entry', 'deviation') AND layer <> 'vessel' THEN 'vessel only' WHEN (layer = 'vessel') = (doc_id % 4 = 2) THEN 'outside the layer''s folder' END AS reject_reason FROM x",
        ),
        "detect_changes": (lambda s, d: t.detect_changes(_sources(s, d, 2), _sources(s, d)).select("source_id", "status"), "SELECT doc_id AS source_id, CASE WHEN doc_id % 10 = 9 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'no-op' END AS status FROM documents"),
        "upsert_source": (
            upsert,
            f"WITH {SRC} SELECT source_id, layer, path, sha256(text || CASE WHEN source_id % 5 = 0 THEN ' edited' ELSE '' END) AS content_hash FROM src "
            "UNION ALL SELECT source_id, layer, replace(path, '/' || source_id || '.md', '/old-' || source_id || '.md'), sha256(text) FROM src WHERE source_id % 10 = 9",
        ),
        "corpus_scan": (
            scan,
            "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.txt' ELSE '.md' END AS suffix, sha256(text) AS text_sha256, 'kept' AS status FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT NULL, '.json', NULL, 'skipped'",
        ),
        "embed_attach": (vectors, None),
        "chunks_sink": (
            sink,
            f"WITH {SRC}, line AS (SELECT source_id, layer, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, layer, string_split(text, chr(10)) AS l FROM src)) "
            f"SELECT CASE WHEN source_id % 7 = 0 THEN source_id + {LOST} ELSE source_id END AS source_id, CAST(i - 1 AS INTEGER) AS ordinal, CASE WHEN layer = 'vessel' AND source_id % 2 = 0 THEN 'community' ELSE layer END AS layer, "
            "CAST(CASE WHEN layer = 'shared' THEN 1 ELSE 2 END AS INTEGER) AS version, sha256(l[i]) AS content_sha256 FROM line",
        ),
        "rel_subtract": (lambda s, d: _sources(s, d).join(t.detect_changes(_sources(s, d, 2), _sources(s, d)).where("status = 'changed'").select("layer", "path"), ["layer", "path"], "left_anti").select("source_id"), "SELECT doc_id AS source_id FROM documents WHERE doc_id % 5 <> 0"),
        "assign_ordinals": (lambda s, d: t.assign_ordinals(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id"), "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS ordinal FROM documents"),
        "quarantine": (
            lambda s, d: t.quarantine(_sources(s, d, 2), _sources(s, d), F.when(F.col("source_id") % 13 == 0, "unreadable")),
            f"WITH {SRC} SELECT path, CASE WHEN source_id % 13 = 0 THEN 'FAIL' WHEN source_id % 10 = 9 OR source_id % 5 = 0 THEN 'OK' ELSE 'NO-OP' END AS result, CASE WHEN source_id % 13 = 0 THEN 'unreadable' END AS error FROM src",
        ),
        "relayer_candidates": (lambda s, d: t.relayer_candidates(_sources(s, d, 2), _chunks(s, d)), f"WITH {SRC} SELECT source_id, path, CASE WHEN source_id % 7 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n_chunks FROM src WHERE layer = 'vessel' AND source_type = 'whatsapp'"),
        "relayer": (lambda s, d: t.relayer(_sources(s, d, 2), _sources(s, d, 2).where("source_id % 2 = 0").select("path")).select("source_id", "layer"), f"WITH {SRC} SELECT source_id, CASE WHEN layer = 'vessel' AND source_id % 2 = 0 THEN 'community' ELSE layer END AS layer FROM src"),
        "delete_cascade": (cascade, f"SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + {LOST} ELSE doc_id END AS source_id, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 7 = 0 OR doc_id % 6 <> 0"),
        "set_null": (nulls, f"WITH {ITEMS} SELECT p_partkey, CASE WHEN zone_id % 4 <> 0 THEN zone_id END AS zone_id FROM items"),
        "list_sources": (lambda s, d: t.list_sources(_sources(s, d, 2), "shared").select("source_id", "layer_rank"), "SELECT doc_id AS source_id, 2 AS layer_rank FROM documents WHERE doc_id % 3 = 0"),
        "concat_layers": (lambda s, d: t.list_sources(_sources(s, d, 2)).select("source_id", "layer_rank"), "SELECT doc_id AS source_id, [2, 3, 1][doc_id % 3 + 1] AS layer_rank FROM documents"),
        "explore_groups": (lambda s, d: t.explore_groups(_sources(s, d, 2)), f"WITH {SRC} SELECT CASE layer WHEN 'vessel' THEN 1 WHEN 'shared' THEN 2 ELSE 3 END AS layer_rank, layer, count(*) AS n_sources, min(path) AS first_path FROM src GROUP BY ALL"),
        "integrity_audit": (
            audit,
            f"""WITH {SRC}, {ITEMS}, line AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, string_split(text, chr(10)) AS l FROM documents)
            SELECT 'source path' AS rule, layer || '|' || path AS item, 2 AS n FROM src WHERE source_id % 50 = 0
            UNION ALL SELECT 'source layer', CASE WHEN source_id % 90 = 1 THEN 'attic' END, count(*) FROM src WHERE source_id % 90 = 1 GROUP BY ALL
            UNION ALL SELECT 'chunk ordinal', CASE WHEN doc_id % 7 = 0 THEN doc_id + {LOST} ELSE doc_id END || '|' || 0, 2 FROM line WHERE doc_id % 40 = 0
            UNION ALL SELECT 'chunk source', CAST(doc_id + {LOST} AS VARCHAR), n + CASE WHEN doc_id % 40 = 0 THEN 1 ELSE 0 END FROM line WHERE doc_id % 7 = 0
            UNION ALL SELECT 'vector chunk', CAST(vec_id * 3 AS VARCHAR), count(*) FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents) GROUP BY ALL
            UNION ALL SELECT * FROM (SELECT 'zone name', s_name, count(*) AS n FROM (SELECT regexp_replace(s_name, '\\d$', '') AS s_name FROM supplier) GROUP BY ALL) WHERE n > 1
            UNION ALL SELECT * FROM (SELECT 'zone slot', c_nationkey || '|' || c_custkey % 30 || '|' || c_custkey % 4, count(*) AS n FROM customer GROUP BY ALL) WHERE n > 1
            UNION ALL SELECT 'item category', lower(p_type), count(*) FROM part WHERE p_size % 2 = 0 GROUP BY ALL
            UNION ALL SELECT 'item zone', CAST(zone_id + 1 AS VARCHAR), count(*) FROM items WHERE zone_id + 1 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""",
        ),
        "ingest_summary": (lambda s, d: t.detect_changes(_sources(s, d, 2), _sources(s, d)).groupBy("layer", "status").agg(F.count(F.lit(1)).alias("n")), f"WITH {SRC} SELECT layer, CASE WHEN source_id % 10 = 9 THEN 'new' WHEN source_id % 5 = 0 THEN 'changed' ELSE 'no-op' END AS status, count(*) AS n FROM src GROUP BY ALL"),
        "list_entries": (lambda s, d: r.list_entries(_entries(s, d), system="purchase", since="2024-01-05", until="2024-01-20").select("entry_id", "date", "system"), f"WITH {ENT} SELECT entry_id, date, system FROM ent WHERE system = 'purchase' AND date BETWEEN '2024-01-05' AND '2024-01-20'"),
        "entry_display": (
            lambda s, d: _entries(s, d).select("entry_id", r.entry_display(F.col("date"), F.when(F.col("entry_id") % 5 > 0, F.col("system")), F.col("content"), F.when(F.col("entry_id") % 3 > 0, F.get_json_object("metadata", "$.k").cast("double")), F.when(F.col("entry_id") % 2 > 0, "EUR")).alias("line")),
            f"WITH {ENT} SELECT entry_id, date || '  ' || CASE WHEN entry_id % 5 > 0 THEN system ELSE '—' END || '  ' || content || '  ' || CASE WHEN entry_id % 3 > 0 THEN json_extract_string(metadata, '$.k') || '.00 ' || CASE WHEN entry_id % 2 > 0 THEN 'EUR' ELSE 'NZD' END ELSE '—' END AS line FROM ent",
        ),
        "filename_collision": (
            lambda s, d: r.entry_filename(_entries(s, d).groupBy("date", "content").agg(F.min("entry_id").alias("entry_id"))).select("entry_id", "file_name"),
            f"WITH {ENT}, e AS (SELECT date, content, min(entry_id) AS entry_id FROM ent GROUP BY ALL), b AS (SELECT *, date || '-' || replace(content, ' ', '-') AS base FROM e) SELECT entry_id, base || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END || '.md' AS file_name FROM b WINDOW w AS (PARTITION BY base ORDER BY entry_id)",
        ),
        "render_entry": (lambda s, d: _entries(s, d).select("entry_id", r.render_entry(["date", "system"]).alias("text")), f"WITH {ENT} SELECT entry_id, '---' || chr(10) || 'date: ' || date || chr(10) || 'system: ' || system || chr(10) || '---' || chr(10) || content AS text FROM ent"),
        "normalise_system": (lambda s, d: table(s, d, "events").select("event_id", r.normalise_system(raw()).alias("system")), "SELECT event_id, ['engine', 'engine', 'electronics/nav', 'other', 'hull/deck', 'other', 'rigging'][event_id % 7 + 1] AS system FROM events"),
        "normalise_category": (lambda s, d: table(s, d, "events").select("event_id", r.normalise_category(cat()).alias("category")), "SELECT event_id, ['safety', 'tool', 'provision', 'toy', 'spare', 'safety', 'spare'][event_id % 7 + 1] AS category FROM events"),
        "validate_category": (
            lambda s, d: r.validate_category(table(s, d, "events").select("event_id", cat().alias("category"))),
            "SELECT event_id, CASE WHEN event_id % 7 = 5 THEN 'safety' END AS category, ['unknown category: flares', 'unknown category: toolbox', 'unknown category: water', 'unknown category: games', 'unknown category: box of shackles', NULL, 'no category'][event_id % 7 + 1] AS reject_reason FROM events",
        ),
        "normalise_side": (lambda s, d: table(s, d, "events").select("event_id", r.normalise_enum(F.when(F.col("event_id") % 3 == 0, " Port").when(F.col("event_id") % 3 == 1, "left"), ["port", "starboard", "centre"]).alias("side")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'port' END AS side FROM events"),
        "item_descriptor": (descriptor, f"WITH {ITEMS} SELECT p_partkey, '[Item] ' || p_name || ' (spare' || CASE WHEN p_size % 3 = 0 THEN ', ' || p_type ELSE '' END || ') — ' || CASE WHEN s_name IS NULL THEN 'location unknown' ELSE s_name || CASE WHEN p_size % 2 = 0 THEN ', row ' || p_size ELSE '' END END || ' Brand: ' || p_brand || ' Part: ' || p_partkey || CASE WHEN p_size % 3 = 0 THEN ' Aliases: ' || p_type ELSE '' END AS descriptor FROM items LEFT JOIN supplier ON s_suppkey = zone_id"),
        "deviation_descriptor": (deviation, f"WITH {ITEMS} SELECT p_partkey, '[Deviation] ' || p_name || ' factory: ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' as-built: ' || p_brand ELSE '' END || ' — ' || coalesce(s_name, 'location unknown') AS descriptor FROM items LEFT JOIN supplier ON s_suppkey = zone_id"),
        "item_zone": (
            lambda s, d: r.item_zone(_items(s, d), _zones(s, d).withColumn("label", F.concat(F.lit("area "), F.col("area").cast("string")))).select("p_partkey", "zone_id", "zone_name", "zone_label"),
            f"WITH {ITEMS} SELECT p_partkey, zone_id, s_name AS zone_name, 'area ' || s_nationkey AS zone_label FROM items LEFT JOIN supplier ON s_suppkey = zone_id",
        ),
        "list_items": (
            lambda s, d: r.list_items(_items(s, d).select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("aliases"), F.lower("p_type").alias("category"), "zone_id"), _zones(s, d).select("zone_id", F.concat(F.lit("z"), (F.col("zone_id") % 3).cast("string")).alias("slug"), F.col("name").alias("label")), "z1", "economy", "R").select("p_partkey", "name", "zone_label"),
            f"WITH {ITEMS} SELECT p_partkey, p_name AS name, s_name AS zone_label FROM items JOIN supplier ON s_suppkey = zone_id WHERE s_suppkey % 3 = 1 AND p_type = 'ECONOMY' AND (contains(lower(p_name), 'r') OR contains(lower(p_brand), 'r'))",
        ),
        "list_zones": (lambda s, d: r.list_zones(_zones(s, d)).select("zone_id", "area", "vertical_index"), "SELECT s_suppkey AS zone_id, s_nationkey AS area, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS vertical_index FROM supplier"),
        "annotation_progress": (
            lambda s, d: r.annotation_progress(_zones(s, d).select("zone_id", "name", F.when(F.col("zone_id") % 2 == 0, F.lit("plan.png")).alias("schematic_image"), F.col("vertical_index").alias("geometry"))),
            "SELECT *, CAST(row_number() OVER (ORDER BY annotated, name, zone_id) - 1 AS INTEGER) AS place, CAST(count_if(annotated) OVER () AS BIGINT) AS n_annotated, count(*) OVER () AS n_zones FROM (SELECT s_suppkey AS zone_id, s_name AS name, s_suppkey % 2 = 0 AND s_suppkey % 6 > 0 AS annotated FROM supplier)",
        ),
        "find_items": (
            find,
            "WITH q AS (SELECT upper(p_name) AS text FROM part UNION SELECT p_brand FROM part UNION SELECT substr(p_type, 2, 2) FROM part UNION SELECT n_name FROM nation) "
            "SELECT text AS query_id, p_partkey FROM part JOIN q ON contains(lower(p_name), lower(text)) OR contains(lower(p_brand), lower(text)) OR contains(lower(p_type), lower(text))",
        ),
        "resolve_zone": (resolve, r"WITH z AS (SELECT regexp_replace(s_name, '\d$', '') AS name, min(s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY 1), x AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN regexp_replace(s_name, '\d$', '') ELSE 'nowhere' END AS zone FROM supplier) SELECT s_suppkey, zone, CASE WHEN n = 1 THEN id END AS zone_id, CASE WHEN trim(zone) = '' THEN 'blank' WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' END AS warning FROM x LEFT JOIN z ON name = zone"),
        "slot_valid": (slots, "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_nationkey % 5 = 4 THEN 'zone has no grid' WHEN c_custkey % 4 > n_regionkey + 1 OR c_custkey % 3 + 1 > 2 THEN 'outside the grid' END AS reason FROM customer JOIN nation ON n_nationkey = c_nationkey"),
        "grid_counts": (
            lambda s, d: r.grid_counts(table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.explode(F.sequence(F.lit(1), F.col("n_regionkey") + 1)).alias("row")).select("zone_id", "row", F.explode(F.array(F.lit(1), F.lit(2))).alias("col")).where("zone_id % 5 <> 4")).withColumn("n_rows", F.col("n_rows").cast("bigint")),
            "SELECT n_nationkey AS zone_id, CAST(2 * (n_regionkey + 1) AS BIGINT) AS n_slots, CAST(n_regionkey + 1 AS BIGINT) AS n_rows, 2 AS n_cols FROM nation WHERE n_nationkey % 5 <> 4",
        ),
        "location_moves": (
            moves,
            "WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), k AS (SELECT user_id, list(event_type ORDER BY event_id DESC) AS l FROM m WHERE before IS NULL OR before <> event_type GROUP BY 1) SELECT user_id, l[1] AS current, CAST(len(l) - 1 AS INTEGER) AS n_moves, l[2:4] AS latest FROM k",
        ),
        "apply_moves": (
            lambda s, d: moves(s, d).select("user_id", "current", F.col("n_moves").alias("n_history"), r.item_descriptor(F.concat(F.lit("item "), F.col("user_id").cast("string")), F.lit("tool"), *[F.lit(None).cast("string")], F.col("current"), *[F.lit(None).cast("string")] * 5).alias("descriptor")),
            "WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, arg_max(event_type, event_id) AS current, CAST(count(*) - 1 AS INTEGER) AS n_history, '[Item] item ' || user_id || ' (tool) — ' || arg_max(event_type, event_id) AS descriptor FROM m WHERE before IS NULL OR before <> event_type GROUP BY 1",
        ),
        "history_places": (
            lambda s, d: moves(s, d).select("user_id", F.array_join("latest", ", ").alias("also_try")),
            "WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), k AS (SELECT user_id, list(event_type ORDER BY event_id DESC) AS l FROM m WHERE before IS NULL OR before <> event_type GROUP BY 1) SELECT user_id, array_to_string(l[2:4], ', ') AS also_try FROM k",
        ),
        "vocabulary": (lambda s, d: r.vocabulary([table(s, d, "part").select("p_brand"), table(s, d, "part").select("p_type")]), "SELECT term, min(p) AS priority FROM (SELECT trim(p_brand) AS term, 0 AS p FROM part UNION ALL SELECT trim(p_type), 1 FROM part) WHERE term <> '' GROUP BY 1 ORDER BY 2, 1 LIMIT 60"),
        "modal_model": (lambda s, d: r.modal_model(table(s, d, "events").select(F.col("event_type").alias("model"))), "SELECT event_type AS model, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
        "model_mismatch": (
            lambda s, d: r.model_mismatch(table(s, d, "events").select(F.col("event_type").alias("model")), table(s, d, "events").agg(F.min("event_type").alias("model"))),
            "SELECT event_type AS model, (SELECT min(event_type) FROM events) AS asked, event_type <> (SELECT min(event_type) FROM events) AS mismatch FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
        ),
        "zone_highlights": (highlights, "SELECT user_id AS query_id, event_id % 11 AS zone_id, min(event_id) AS first_rank, CASE WHEN bool_or(event_type = 'error') THEN 'deviation' ELSE 'inventory' END AS kind FROM events WHERE event_id % 9 > 0 GROUP BY ALL"),
        "item_metadata": (
            lambda s, d: table(s, d, "part").select("p_partkey", item_metadata(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.lit("2027-01-01")), F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise("2026-12-31"), F.when(F.col("p_size") % 7 == 0, F.col("p_type"))).alias("metadata")),
            """SELECT p_partkey, '{' || concat_ws(',', CASE WHEN p_size % 2 = 0 THEN '"part_number":"' || p_brand || '"' END, CASE WHEN p_size % 3 = 0 THEN '"best_before":"2027-01-01"' END, CASE WHEN p_size % 5 <> 0 THEN '"expiry":"2026-12-31"' END,
            CASE WHEN p_size % 7 = 0 THEN '"last_inspected":"' || p_type || '"' END) || '}' AS metadata FROM part""",
        ),
        "touch_updated": (
            lambda s, d: t.touch_updated(_sources(s, d, 2), _sources(s, d).withColumn("updated_at", F.lit("2025-01-01").cast("date")), F.lit("2026-05-30").cast("date")).select("source_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at")),
            "SELECT doc_id AS source_id, CASE WHEN doc_id % 10 = 9 OR doc_id % 5 = 0 THEN '2026-05-30' ELSE '2025-01-01' END AS updated_at FROM documents",
        ),
    }
