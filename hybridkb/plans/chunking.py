"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridkb.operators import chunking
from hybridkb.plans.tables import table

TOKENS = r"(len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')) + len(regexp_extract_all({0}, '[^\p{{L}}\p{{N}}_\s]')) // 2)"


def _lines(s, d):
    """Chat exports made of the conversations: three turns a quarter of an hour apart, then an hour's gap."""
    c = table(s, d, "conversations")
    at = F.make_timestamp(F.lit(2024), F.lit(3), F.lit(1), F.lit(8), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), F.floor(F.col("turn") / 3), F.col("turn") % 3 * 15)
    head = F.concat(F.date_format(at, "dd/MM/yyyy, HH:mm"), F.lit(" - "), "role", F.lit(": "), "text")
    return c.select(F.col("conv_id").alias("chat_id"), "turn", F.posexplode(F.split(head, "\n")).alias("i", "line")).select("chat_id", (F.col("turn") * 100000 + F.col("i")).alias("line_no"), "line")


# The lines of these exports, and what message_lines says of them.
CHATS_SQL = r"""l AS (SELECT conv_id, turn, unnest(range(1, len(x) + 1)) AS i, x, role FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS x FROM conversations)),
p AS (SELECT *, x[i] AS line, CASE WHEN i = 1 THEN role || ': ' || x[1] END AS payload FROM l),
h AS (SELECT *, regexp_extract(payload, '^(.*): (.*)$', 1) AS sender, regexp_extract(payload, '^(.*): (.*)$', 2) AS body FROM p),
k AS (SELECT *, i = 1 AND trim(sender) <> '' AND len(list_filter({prefixes}, lambda s: starts_with(body, s))) = 0 AS kept FROM h),
o AS (SELECT *, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, i) AS owner FROM k),
m AS (SELECT *, TIMESTAMP '2024-03-01 08:00:00' + to_hours(CAST(turn // 3 AS INTEGER)) + to_minutes(CAST(turn % 3 * 15 AS INTEGER)) AS sent FROM o WHERE (kept OR i > 1) AND owner > 0)""".replace("{prefixes}", str(list(chunking.SYSTEM_PREFIXES)))


def pack_sql(name: str, source: str, keys: str, cap: int = 200) -> str:
    """CTEs that pack the lists ``l`` of sentences of the rows of ``source``: the last, ``name``, has a row for each part."""
    join = " AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    old = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    full = f"f.w + s.w + (f.p + s.p) // 2 > {cap}"
    return rf"""{name}_s AS (SELECT {keys}, x, i, len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) AS w, len(regexp_extract_all(x, '[^\p{{L}}\p{{N}}_\s]')) AS p
  FROM (SELECT {keys}, l[i] AS x, i FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS i FROM {source}))),
{name}_f AS (SELECT {keys}, i, w, p, 1 AS part, x FROM {name}_s WHERE i = 1
  UNION ALL SELECT {old}, s.i, CASE WHEN {full} THEN s.w ELSE f.w + s.w END, CASE WHEN {full} THEN s.p ELSE f.p + s.p END, f.part + CASE WHEN {full} THEN 1 ELSE 0 END, s.x FROM {name}_f f JOIN {name}_s s ON {join} AND s.i = f.i + 1),
{name} AS (SELECT {keys}, part, string_agg(x, ' ' ORDER BY i) AS content, count(*) AS n FROM {name}_f GROUP BY {keys}, part)"""


def words_sql(name: str, source: str, keys: str, cap: int = 200) -> str:
    """CTEs that pack the texts ``x`` of the rows of ``source`` by sentences, and longer sentences by words; ``name`` has a row for
    each part with ``content``."""
    ks = [k.strip() for k in keys.split(",")]
    joined = lambda *more: " AND ".join(f"s.{k} = f.{k}" for k in [*ks, *more])
    listed = lambda *more: ", ".join(f"s.{k}" for k in [*ks, *more])
    count = lambda x: TOKENS.format(x)
    return rf"""{name}_q AS (SELECT {keys}, si, l[si] AS x, {count('l[si]')} AS n FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS si
  FROM (SELECT {keys}, list_filter(string_split(regexp_replace(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS l FROM {source}))),
{name}_w AS (SELECT {keys}, si, wi, l[wi] AS x, {count('l[wi]')} AS n FROM (SELECT {keys}, si, l, unnest(range(1, len(l) + 1)) AS wi FROM (SELECT {keys}, si, list_filter(string_split_regex(x, '\s+'), lambda y: y <> '') AS l FROM {name}_q WHERE n > {cap}))),
{name}_v AS (SELECT {keys}, si, wi, n, 1 AS piece, x FROM {name}_w WHERE wi = 1
  UNION ALL SELECT {listed('si')}, s.wi, CASE WHEN f.n + s.n > {cap} THEN s.n ELSE f.n + s.n END, f.piece + CASE WHEN f.n + s.n > {cap} THEN 1 ELSE 0 END, s.x FROM {name}_v f JOIN {name}_w s ON {joined('si')} AND s.wi = f.wi + 1),
{name}_u AS (SELECT {keys}, x, {count('x')} AS n, row_number() OVER (PARTITION BY {keys} ORDER BY si, piece) AS i
  FROM (SELECT {keys}, si, 0 AS piece, x FROM {name}_q WHERE n <= {cap} UNION ALL SELECT {keys}, si, piece, string_agg(x, ' ' ORDER BY wi) FROM {name}_v GROUP BY {keys}, si, piece)),
{name}_f AS (SELECT {keys}, i, n, 1 AS part, x FROM {name}_u WHERE i = 1
  UNION ALL SELECT {listed()}, s.i, CASE WHEN f.n + s.n > {cap} THEN s.n ELSE f.n + s.n END, f.part + CASE WHEN f.n + s.n > {cap} THEN 1 ELSE 0 END, s.x FROM {name}_f f JOIN {name}_u s ON {joined()} AND s.i = f.i + 1),
{name} AS (SELECT {keys}, part, string_agg(x, ' ' ORDER BY i) AS content FROM {name}_f GROUP BY {keys}, part)"""


SENTENCES = r"list_filter(string_split(regexp_replace({0}, '(\.)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
HEADINGS_SQL = r"""t AS (SELECT doc_id, flatten(list_transform(range(1, len(l) + 1), lambda k: CASE (k - 1) % 4 WHEN 0 THEN ['# ' || l[k], l[k]] WHEN 2 THEN ['## ' || l[k], l[k]] ELSE [l[k]] END)) AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
l AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END AS level FROM l),
n AS (SELECT *, count(level) OVER w AS section_no, max(CASE WHEN level = 1 THEN line_no END) OVER w AS l1, max(CASE WHEN level = 2 THEN line_no END) OVER w AS l2 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT n.*, a.line AS t1, b.line AS t2 FROM n LEFT JOIN l a ON a.doc_id = n.doc_id AND a.line_no = n.l1 LEFT JOIN l b ON b.doc_id = n.doc_id AND b.line_no = n.l2 AND n.l2 > coalesce(n.l1, -1)),
path AS (SELECT doc_id, line_no, line, level, section_no, CASE WHEN t1 IS NULL AND t2 IS NULL THEN 'Preamble' ELSE concat_ws(' > ', trim(t1), trim(t2)) END AS path FROM p)"""


def chat_lines(s, d):
    return chunking.chat_lines(_lines(s, d)).select("chat_id", "seq", "day", "time", "sender", F.sha2("body", 256).alias("body_sha256"))


def _messages(s, d):
    c = table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), F.floor(F.col("turn") / 3).alias("session"), F.col("role").alias("sender"), F.col("text").alias("body"))


def chat_chunks(s, d):
    return chunking.chat_chunks(_messages(s, d)).select("chat_id", "session", "part", "n_messages", F.sha2("content", 256).alias("content_sha256"))


def _markdown(s, d):
    """Documents with a heading before every second line, of the same text; the lines stay."""
    with_head = lambda mark, x: F.concat(F.lit(mark), x, F.lit("\n"), x)
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, with_head("# ", x)).when(i % 4 == 2, with_head("## ", x)).otherwise(x)), "\n")
    return table(s, d, "documents").select("doc_id", text.alias("text"))


def pack_sentences(s, d):
    parts = table(s, d, "documents").select("doc_id", F.size(chunking.split_sentences(F.col("text"))).alias("n_sentences"), chunking.pack_sentences(F.col("text")).alias("parts"))
    return parts.select("doc_id", "n_sentences", F.size("parts").alias("n_parts"), F.sha2(F.array_join("parts", "\n"), 256).alias("parts_sha256"))


def blank_line_blocks(s, d):
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return chunking.blank_line_blocks(table(s, d, "documents").select("doc_id", spaced.alias("text"))).select("doc_id", "ordinal", "section_path", F.sha2("content", 256).alias("content_sha256"))


def _front(s, d):
    p = table(s, d, "part")
    value = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('"'), "p_name", F.lit(': x"'))).when(F.col("p_partkey") % 4 == 1, "null").otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("---\nname: "), value, F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit("\n---\nbody of "), "p_brand").alias("text"))


def maintenance_chunk(s, d):
    f = chunking.front_matter(_front(s, d))
    return f.select("doc_id", F.lit("Maintenance Log").alias("section_path"), F.col("body").alias("content"), F.col("fields")["size"].alias("size"))


def entries() -> dict:
    """key: (query, SQL or None)."""
    return {
        "pack_sentences": (
            pack_sentences,
            f"WITH RECURSIVE doc AS (SELECT doc_id, {SENTENCES.format('text')} AS l FROM documents), {pack_sql('pack', 'doc', 'doc_id')} "
            "SELECT doc.doc_id, CAST(len(l) AS INTEGER) AS n_sentences, CAST(count(content) AS INTEGER) AS n_parts, sha256(coalesce(string_agg(content, chr(10) ORDER BY part), '')) AS parts_sha256 FROM doc LEFT JOIN pack USING (doc_id) GROUP BY doc.doc_id, len(l)",
        ),
        "blank_line_blocks": (
            blank_line_blocks,
            rf"""WITH RECURSIVE b AS (SELECT doc_id, i, trim(x[i]) AS block FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n{{2,}}') AS x FROM documents)) WHERE trim(x[i]) <> ''),
            doc AS (SELECT doc_id, i AS block_no, {SENTENCES.format('block')} AS l FROM b), {pack_sql('pack', 'doc', 'doc_id, block_no')},
            n AS (SELECT doc_id, block_no, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, block_no, max(part) AS n FROM pack GROUP BY ALL))
            SELECT doc_id, CAST(before + part - 1 AS INTEGER) AS ordinal, CASE WHEN day <> '' THEN day ELSE 'Block ' || CAST(before AS BIGINT) END AS section_path, sha256(content) AS content_sha256
            FROM pack JOIN n USING (doc_id, block_no) JOIN (SELECT doc_id, i AS block_no, regexp_extract(block, '^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1) AS day FROM b) USING (doc_id, block_no)""",
        ),
        "markdown_sections": (
            lambda s, d: chunking.markdown_sections(_markdown(s, d)).select("doc_id", "ordinal", "section_path", F.sha2("content", 256).alias("content_sha256")),
            rf"""WITH RECURSIVE {HEADINGS_SQL}, body AS (SELECT doc_id, section_no, path, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS body FROM path WHERE level IS NULL GROUP BY ALL),
            doc AS (SELECT doc_id, section_no, path, {SENTENCES.format('body')} AS l FROM body WHERE body <> ''), {pack_sql('pack', 'doc', 'doc_id, section_no, path')}
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part) - 1 AS INTEGER) AS ordinal, path AS section_path,
                   sha256(CASE WHEN path = 'Preamble' THEN content ELSE replace(path, ' > ', chr(10)) || chr(10) || chr(10) || content END) AS content_sha256 FROM pack""",
        ),
        "heading_ancestors": (
            lambda s, d: chunking.heading_ancestors(_markdown(s, d)).select("doc_id", "line_no", "level", "section_no", "path"),
            f"WITH {HEADINGS_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(level AS INTEGER) AS level, section_no, path FROM path",
        ),
        "section_ordinal": (
            lambda s, d: chunking.section_ordinal(table(s, d, "documents").select(F.col("lang").alias("section_path"), F.col("source").alias("doc_id"), F.col("doc_id").alias("ordinal"))),
            "SELECT lang AS section_path, source AS doc_id, doc_id AS ordinal, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS INTEGER) AS section_ordinal FROM documents",
        ),
        "gap_sessions": (
            lambda s, d: chunking.gap_sessions(table(s, d, "events")).select("event_id", "session"),
            "SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)",
        ),
        "chat_lines": (
            chat_lines,
            f"WITH {CHATS_SQL} SELECT conv_id AS chat_id, CAST(owner AS INTEGER) AS seq, max(CASE WHEN kept THEN strftime(sent, '%d/%m/%Y') END) AS day, max(CASE WHEN kept THEN strftime(sent, '%H:%M') END) AS time, max(CASE WHEN kept THEN sender END) AS sender, "
            "sha256(string_agg(CASE WHEN NOT kept THEN line WHEN body = '<Media omitted>' THEN '[media]' ELSE body END, chr(10) ORDER BY turn, i)) AS body_sha256 FROM m GROUP BY conv_id, owner",
        ),
        "continuation_owner": (
            lambda s, d: chunking.continuation_owner(_lines(s, d)),
            f"WITH {CHATS_SQL} SELECT conv_id AS chat_id, turn * 100000 + i - 1 AS line_no, CAST(owner AS INTEGER) AS owner FROM m WHERE NOT kept",
        ),
        "chat_chunks": (
            chat_chunks,
            rf"""WITH RECURSIVE m AS (SELECT conv_id AS chat_id, turn // 3 AS session, turn, row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn) AS i, role || ': ' || text AS line FROM conversations),
            t AS (SELECT *, {TOKENS.format('line')} AS n FROM m),
            f AS (SELECT chat_id, session, i, n, 0 AS part, line FROM t WHERE i = 1
              UNION ALL SELECT t.chat_id, t.session, t.i, CASE WHEN f.n + t.n > 200 THEN t.n ELSE f.n + t.n END, f.part + CASE WHEN f.n + t.n > 200 THEN 1 ELSE 0 END, t.line FROM f JOIN t ON t.chat_id = f.chat_id AND t.session = f.session AND t.i = f.i + 1)
            SELECT chat_id, session, CAST(part AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_messages, sha256(string_agg(line, chr(10) ORDER BY i)) AS content_sha256 FROM f GROUP BY ALL""",
        ),
        "front_matter": (
            lambda s, d: chunking.front_matter(_front(s, d)).select("doc_id", F.col("fields")["name"].alias("name"), F.col("fields")["size"].alias("size"), "body"),
            "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN p_name || ': x' WHEN 1 THEN NULL ELSE p_name END AS name, CAST(p_size AS VARCHAR) AS size, 'body of ' || p_brand AS body FROM part",
        ),
        "maintenance_chunk": (maintenance_chunk, "SELECT p_partkey AS doc_id, 'Maintenance Log' AS section_path, 'body of ' || p_brand AS content, CAST(p_size AS VARCHAR) AS size FROM part"),
    }
