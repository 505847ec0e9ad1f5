"""Queries of the column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.functions import dates, text
from hybridkb.operators.pages import page_selection, selected_pages
from hybridkb.operators.records import sub_slot_grid
from hybridkb.plans.tables import table

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TODAY = "2026-05-30"


# Column expressions need a running session, so they are made when a query runs.


def _text():
    return F.col("text")


def _fenced():
    return F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))


def _wrapped():
    return F.concat(F.lit("so: "), F.col("props"), F.lit(' and {"later": 1}'))


def _confidence():
    return text.clamp_confidence(F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.round(F.col("value") / 50 - 0.5, 4).cast("string")))


def _sku():
    return F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, ": 50%_off").otherwise(""))


def _pages():
    size = F.col("p_size")
    spec = F.array(F.concat((size + 1).cast("string"), F.lit("-"), (size + 3).cast("string")), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(size.cast("string")))
    return F.array_join(spec, ",")


def _names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _q(name, columns):
    return lambda s, d: table(s, d, name).select(*columns())


def _chat(s, d):
    """Chat-export dates made of the events' time stamps, in several formats by event."""
    e = table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    day = F.when(F.col("event_id") % 4 == 0, F.date_format("t", "dd/MM/yyyy")).when(F.col("event_id") % 4 == 1, F.date_format("t", "dd.MM.yy")).when(F.col("event_id") % 4 == 2, F.date_format("t", "M/d/yyyy")).otherwise(F.date_format("t", "dd-MM-yyyy"))
    time = F.when(F.col("event_id") % 3 == 0, F.date_format("t", "HH:mm")).when(F.col("event_id") % 3 == 1, F.date_format("t", "HH:mm:ss")).otherwise(F.concat(F.date_format("t", "hh:mm"), F.lit(" pm")))
    return e.select("event_id", day.alias("day"), time.alias("time"))


CHAT_SQL = """chat AS (SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d/%m/%Y') WHEN 1 THEN strftime(ts, '%d.%m.%y') WHEN 2 THEN strftime(ts, '%-m/%-d/%Y') ELSE strftime(ts, '%d-%m-%Y') END AS day,
  CASE event_id % 3 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%I:%M') || ' pm' END AS time FROM events)"""


def _free_dates(s, d):
    e = table(s, d, "events").withColumn("t", F.col("ts").cast("date"))
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.date_format("t", "yyyy-MM-dd")).when(k == 1, F.date_format("t", "d/M/yyyy")).when(k == 2, F.date_format("t", "d/M"))
        .when(k == 3, F.lit("yesterday evening")).when(k == 4, F.concat(F.lit("last "), F.date_format("t", "EEEE"))).when(k == 5, F.lit("sometime")).otherwise(F.lit(None))
    )
    return e.select("event_id", dates.normalise_date(raw, F.lit(TODAY).cast("date")).alias("day"))


FREE_DATES_SQL = f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts + INTERVAL 731 DAY, '2026-%m-%d')
 WHEN 3 THEN '2026-05-29' WHEN 4 THEN strftime(DATE '{TODAY}' - CAST(CASE WHEN (isodow(DATE '{TODAY}') - isodow(ts) + 7) % 7 = 0 THEN 7 ELSE (isodow(DATE '{TODAY}') - isodow(ts) + 7) % 7 END AS INTEGER), '%Y-%m-%d')
 ELSE '{TODAY}' END AS day FROM events"""
FREE_DATES_SQL = FREE_DATES_SQL.replace("strftime(ts + INTERVAL 731 DAY, '2026-%m-%d')", "'2026-' || strftime(ts, '%m-%d')")


def entries() -> dict:
    """key: (query, SQL or None)."""
    alias_sql = f"CASE WHEN coalesce(s, '') = '' THEN 'Unknown Sailor' ELSE {_names(text.ADJECTIVES)}[CAST('0x' || sha256(s)[1:2] AS INTEGER) % 36 + 1] || ' ' || {_names(text.NOUNS)}[CAST('0x' || sha256(s)[3:4] AS INTEGER) % 36 + 1] || ' ' || lpad(CAST(CAST('0x' || sha256(s)[5:6] AS INTEGER) % 100 AS VARCHAR), 2, '0') END"
    return {
        "token_count": (_q("documents", lambda: ["doc_id", text.token_count(_text()).alias("n_tokens")]), rf"SELECT doc_id, CAST(len({WORDS}) + len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s]')) // 2 AS INTEGER) AS n_tokens FROM documents"),
        "slugify": (
            _q("documents", lambda: ["doc_id", text.slugify(_text()).alias("slug")]),
            rf"SELECT doc_id, regexp_replace(substring(regexp_replace(trim(regexp_replace(array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1:5], ' '), '[^\p{{L}}\p{{N}}_\s-]', '', 'g')), '\s+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g') AS slug FROM documents",
        ),
        "sender_alias": (_q("events", lambda: ["event_id", text.sender_alias(F.when(F.col("event_id") % 50 > 0, F.col("user_id").cast("string"))).alias("alias")]), f"SELECT event_id, {alias_sql} AS alias FROM (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN CAST(user_id AS VARCHAR) END AS s FROM events)"),
        "fold_spaces": (_q("documents", lambda: ["doc_id", F.sha2(text.fold_spaces(_text()), 256).alias("folded_sha256")]), "SELECT doc_id, sha256(replace(replace(text, chr(8239), ' '), chr(160), ' ')) AS folded_sha256 FROM documents"),
        "escape_like": (_q("part", lambda: ["p_partkey", text.escape_like(_sku()).alias("escaped")]), r"SELECT p_partkey, replace(replace(replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN ': 50%_off' ELSE '' END, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM part"),
        "strip_fences": (_q("conversations", lambda: ["conv_id", "turn", F.sha2(text.strip_fences(_fenced()), 256).alias("inner_sha256")]), "SELECT conv_id, turn, sha256(text) AS inner_sha256 FROM conversations"),
        "first_json_object": (_q("events", lambda: ["event_id", text.first_json_object(_wrapped()).alias("object")]), "SELECT event_id, props AS object FROM events"),
        "yaml_quote": (_q("part", lambda: ["p_partkey", text.yaml_quote(_sku()).alias("quoted")]), """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '"' || p_name || ': 50%_off"' ELSE p_name END AS quoted FROM part"""),
        "yaml_unquote": (_q("part", lambda: ["p_partkey", text.yaml_unquote(text.yaml_quote(_sku())).alias("plain")]), "SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ': 50%_off' ELSE '' END AS plain FROM part"),
        "page_selection": (
            lambda s, d: page_selection(table(s, d, "part").select("p_partkey", _pages().alias("spec"))).drop("spec"),
            "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE list_sort(list_distinct([p_size, p_size + 1, p_size + 2, p_size + 3])) END AS pages, CASE WHEN p_partkey % 5 = 0 THEN 'not a page' END AS reason FROM part",
        ),
        "normalise_date": (_free_dates, FREE_DATES_SQL),
        "chat_timestamp": (
            lambda s, d: _chat(s, d).select("event_id", dates.chat_timestamp(F.col("day"), F.col("time")).alias("t")),
            f"WITH {CHAT_SQL} SELECT event_id, coalesce("
            + ", ".join(f"CASE WHEN regexp_matches(day, '\\D\\d{{2}}$') = {str(y == '%y').lower()} THEN try_strptime(replace(replace(day, '.', '/'), '-', '/') || ' ' || upper(time), '{o}{y} {c}') END" for c in ("%I:%M:%S %p", "%I:%M %p", "%H:%M:%S", "%H:%M") for o in ("%d/%m/", "%m/%d/") for y in ("%y", "%Y"))
            + ") AS t FROM chat",
        ),
        "date_format_label": (
            lambda s, d: _chat(s, d).select("event_id", dates.date_format_label(F.col("day"), F.col("time")).alias("label")),
            f"""WITH {CHAT_SQL} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DD/MM/YYYY' WHEN 1 THEN 'DD.MM.YY' WHEN 3 THEN 'DD-MM-YYYY'
              ELSE CASE WHEN CAST(split_part(day, '/', 1) AS INTEGER) <= 12 AND CAST(split_part(day, '/', 2) AS INTEGER) > 12 THEN 'MM/DD/YYYY' ELSE 'DD/MM/YYYY' END END
              || ' ' || CASE event_id % 3 WHEN 0 THEN 'HH:MM (24h)' WHEN 1 THEN 'HH:MMSS (24h)' ELSE 'h:MM AM/PM' END AS label FROM chat""",
        ),
        "clamp_confidence": (
            _q("events", lambda: ["event_id", _confidence()[0].alias("confidence"), _confidence()[1].alias("downgraded")]),
            "SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(v, 0))) AS confidence, v IS NULL OR v < 0 OR v > 1 AS downgraded FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value / 50 - 0.5, 4) END AS v FROM events)",
        ),
        "json_field": (_q("events", lambda: ["event_id", text.json_field(F.col("props"), "k").alias("k")]), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
        "json_valid": (_q("events", lambda: ["event_id", text.json_valid(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))).alias("valid")]), "SELECT event_id, event_id % 3 <> 0 AS valid FROM events"),
        "safe_json": (
            _q("events", lambda: ["event_id", F.size(text.safe_json(F.when(F.col("event_id") % 3 == 0, "[1]").otherwise(F.col("props")))).alias("n_keys")]),
            "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(len(json_keys(props)) AS INTEGER) END AS n_keys FROM events",
        ),
        "coerce_str_list": (_q("events", lambda: ["event_id", text.coerce_str_list(F.when(F.col("event_id") % 3 == 0, '["a ", "", "b"]').when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.col("props"))).alias("items")]), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN [event_type] ELSE CAST([] AS VARCHAR[]) END AS items FROM events"),
        "coerce_scalar": (_q("events", lambda: ["event_id", text.coerce_scalar(F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("event_type"))).otherwise(" ")).alias("value")]), "SELECT event_id, CASE event_id % 3 WHEN 1 THEN event_type END AS value FROM events"),
        "sub_slot_grid": (
            lambda s, d: sub_slot_grid(table(s, d, "nation").withColumn("zone_id", F.col("n_nationkey")), F.col("n_regionkey") + 1, F.lit(2), F.split("n_name", " ")),
            "SELECT n_nationkey AS zone_id, r AS row, c AS col, string_split(n_name, ' ')[r] AS row_label FROM (SELECT *, unnest([1, 2]) AS c FROM (SELECT *, CAST(unnest(range(1, n_regionkey + 2)) AS INTEGER) AS r FROM nation))",
        ),
        "selected_pages": (
            lambda s, d: selected_pages(table(s, d, "documents").select("doc_id", F.concat_ws(",", F.lit("1-2"), (F.col("doc_id") % 9 + 1).cast("string")).alias("spec")), table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line")).select("doc_id", (F.col("page") + 1).alias("page"), F.sha2("line", 256).alias("line_sha256"))),
            "SELECT doc_id, CAST(i AS INTEGER) AS page, sha256(l[i]) AS line_sha256 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE i <= 2 OR i = doc_id % 9 + 1",
        ),
        "geometry_valid": (
            _q("events", lambda: ["event_id", text.geometry_valid(F.transform(F.sequence(F.lit(1), F.lit(2) + (F.col("event_id") % 3).cast("int")), lambda i: F.array(F.col("value") / 100, F.lit(0.5) * (i % 2)))).alias("valid")]),
            "SELECT event_id, event_id % 3 > 0 AND value / 100 >= 0 AND value / 100 <= 1 AS valid FROM events",
        ),
        "text_contains_any": (_q("events", lambda: ["event_id", text.text_contains_any(F.lit("PURCHASE"), F.col("event_type"), F.col("props")).alias("found")]), "SELECT event_id, contains(lower(event_type), 'purchase') OR contains(lower(props), 'purchase') AS found FROM events"),
        "content_fingerprint": (_q("documents", lambda: ["doc_id", text.content_fingerprint(_text()).alias("content_hash")]), r"SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g'))) AS content_hash FROM documents"),
        "chunk_hash": (_q("documents", lambda: ["doc_id", text.chunk_hash(F.col("text")).alias("content_hash")]), "SELECT doc_id, sha256(text) AS content_hash FROM documents"),
        "anchor_key": (_q("documents", lambda: ["doc_id", text.anchor_key(F.col("source"), F.col("lang"), F.col("doc_id") % 5).alias("anchor_key")]), "SELECT doc_id, sha256(source || chr(10) || lang || chr(10) || doc_id % 5) AS anchor_key FROM documents"),
    }
