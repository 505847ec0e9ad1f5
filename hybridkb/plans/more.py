"""Queries of pages and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.operators import pages, payloads
from hybridkb.plans.chunking import words_sql
from hybridkb.plans.tables import table


def _spans(s, d):
    """Spans made of documents: a page every 12 lines, the first line of every second page in large type."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    page = F.floor(F.col("i") / 12).cast("int")
    return lines.select("doc_id", page.alias("page"), (F.col("i") % 12).alias("span_no"), F.when((F.col("i") % 12 == 0) & (page % 2 == 0), 18.0).otherwise(10.0).alias("size"), F.lit("Serif").alias("font"), "text")


# The size is larger than 1.15 medians unless the page has no other span.
SPANS_SQL = """span AS (SELECT *, i % 12 = 0 AND page % 2 = 0 AND trim(text) <> '' AND count(*) OVER (PARTITION BY doc_id, page) > 1 AS heading
  FROM (SELECT doc_id, i, i // 12 AS page, i % 12 AS span_no, l[i + 1] AS text FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


def _payload(s, d):
    e = table(s, d, "events")
    good = F.concat(F.lit('```json\n{"system": "engine", "cost_amount": '), F.col("value").cast("string"), F.lit(', "parts": ["a", " "], "vendor": "'), "event_type", F.lit('"}\n```'))
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, "no").otherwise(good).alias("first"), F.when(F.col("event_id") % 6 == 0, "no").otherwise('{"system": "sails", "parts": 3}').alias("retry"))


def ladder(s, d):
    out = payloads.extraction_ladder(_payload(s, d), "first", "retry")
    return out.select("event_id", "rung", F.col("record.system").alias("system"), F.col("record.cost_amount").alias("cost"), F.size("record.parts").alias("n_parts"), F.col("record.vendor").alias("vendor"))


def entries() -> dict:
    """key: (query, SQL or None)."""
    return {
        "median_font": (lambda s, d: pages.median_font(_spans(s, d)), "SELECT doc_id, CAST((i - 1) // 12 AS INTEGER) AS page, median(CASE WHEN (i - 1) % 12 = 0 AND (i - 1) // 12 % 2 = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END) AS median_size FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY ALL"),
        "span_headings": (
            lambda s, d: pages.span_headings(_spans(s, d)).where("heading").select("doc_id", "page", "span_no", F.sha2("text", 256).alias("text_sha256")),
            f"WITH {SPANS_SQL} SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(span_no AS INTEGER) AS span_no, sha256(text) AS text_sha256 FROM span WHERE heading",
        ),
        "span_sections": (
            lambda s, d: pages.span_sections(_spans(s, d)).select("doc_id", "section", "page_start", "page_end", F.sha2("content", 256).alias("content_sha256")),
            f"""WITH {SPANS_SQL}, page AS (SELECT doc_id, page, max(CASE WHEN heading THEN trim(text) END) AS h, coalesce(string_agg(CASE WHEN NOT heading AND trim(text) <> '' THEN text END, ' ' ORDER BY span_no), '') AS body, count_if(heading) AS n FROM span GROUP BY ALL),
            named AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY doc_id) < 3 THEN 'Page ' || page ELSE coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), 'Page ' || page) END AS section FROM page),
            run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM (SELECT *, CASE WHEN section IS NOT DISTINCT FROM lag(section) OVER (PARTITION BY doc_id ORDER BY page) THEN 0 ELSE 1 END AS fresh FROM named)),
            x AS (SELECT doc_id, section, run, CAST(min(page) AS INTEGER) AS page_start, CAST(max(page) AS INTEGER) AS page_end, string_agg(body, chr(10) ORDER BY page) AS content FROM run GROUP BY ALL)
            SELECT doc_id, section, page_start, page_end, sha256(content) AS content_sha256 FROM x WHERE trim(content) <> ''""",
        ),
        "pack_words": (
            lambda s, d: table(s, d, "documents").select("doc_id", pages.pack_words(F.col("text")).alias("parts")).select("doc_id", F.size("parts").alias("n_parts"), F.sha2(F.array_join("parts", "\n"), 256).alias("parts_sha256")),
            f"WITH RECURSIVE doc AS (SELECT doc_id, text AS x FROM documents), {words_sql('pack', 'doc', 'doc_id')} SELECT doc.doc_id, CAST(count(content) AS INTEGER) AS n_parts, sha256(coalesce(string_agg(content, chr(10) ORDER BY part), '')) AS parts_sha256 FROM doc LEFT JOIN pack USING (doc_id) GROUP BY doc.doc_id",
        ),
        "extraction_ladder": (
            ladder,
            "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'first' WHEN event_id % 6 <> 0 THEN 'retry' ELSE 'default' END AS rung, CASE WHEN event_id % 3 <> 0 THEN 'engine' WHEN event_id % 6 <> 0 THEN 'sails' ELSE 'other' END AS system, CASE WHEN event_id % 3 <> 0 THEN value END AS cost, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS n_parts, CASE WHEN event_id % 3 <> 0 THEN event_type END AS vendor FROM events",
        ),
    }
