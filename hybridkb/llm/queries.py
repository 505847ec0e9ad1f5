"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.topk import exact_top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.decontaminate import contamination_report

    report = contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return report.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.token_counts import context_totals, length_histogram

    return context_totals(length_histogram(_table(spark, sf_dir, "documents")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.sentencepiece_sa import decode_column, encode_documents

    encoded = encode_documents(_table(spark, sf_dir, "documents"))
    back = decode_column(encoded) == F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", back.alias("round_trip"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.suffix_dedup import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.html_wrapper import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.spelling import spelling_forms

    return spelling_forms(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hybridkb.llm.filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS i
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.i, c.i), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.i) = len(c.i) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 5
"""

OP3_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
docwin AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, p, docwin.size FROM docwin JOIN win USING (size, t)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP4_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, hash(t) AS h, t FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) END) AS t FROM doc)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingle a JOIN shingle b ON a.h = b.h AND a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM size UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc.doc_id) AS component_id, coalesce(component_id, doc.doc_id) = doc.doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN component USING (doc_id)
"""

# The hexadecimal form of a text has two characters for each byte.
OP8_SQL = r"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
string AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS p FROM doc WHERE length(x) >= 200)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM string) WHERE nth > 1),
cut AS (SELECT doc_id, p, coalesce(p - lag(p) OVER w > 100, true) AS fresh, coalesce(lead(p) OVER w - p > 100, true) AS final FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
span AS (SELECT doc_id, p AS lo, CASE WHEN final THEN p ELSE lead(p) OVER (PARTITION BY doc_id ORDER BY p) END + 100 AS hi, fresh FROM cut WHERE fresh OR final),
gone AS (SELECT doc_id, lo, hi FROM span WHERE fresh),
piece AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM (SELECT * FROM gone UNION ALL SELECT doc_id, -1, 0 FROM doc)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (coalesce(piece.hi, length(x) // 2) - lo)), '' ORDER BY lo) AS x FROM piece JOIN doc USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT doc.doc_id, CAST(length(doc.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM doc JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


# Letters of a run are one byte, or two if they are beyond ASCII: 195 and the code less 64.
OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
run AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN unicode(x[i]) < 128 THEN [unicode(x[i])::BIGINT] ELSE [195::BIGINT, unicode(x[i])::BIGINT - 64] END)) AS b
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS x FROM run)),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT a.word, b.word AS near FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT del.word, w.word FROM del JOIN word w ON w.word = del.d
  UNION SELECT w.word, del.word FROM del JOIN word w ON w.word = del.d),
best AS (
  SELECT near.word, count(*) AS n_near, first(near.near ORDER BY w.n DESC, encode(near.near)) AS near, max(w.n) AS near_n
  FROM near JOIN word w ON w.word = near.near GROUP BY near.word),
judged AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM word LEFT JOIN best USING (word)),
walk(word, root) AS (SELECT word, word FROM judged UNION ALL SELECT walk.word, judged.form FROM walk JOIN judged ON judged.word = walk.root WHERE judged.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT walk.word, root FROM walk JOIN judged ON judged.word = root WHERE judged.form IS NULL) USING (word)
"""

OP13_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
fails AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed FROM doc),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN lab USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, '[' || substr(filter_order, 1, step) || ']' AS upto, '[_' || substr(filter_order, 1, step - 1) || ']' AS before FROM ord, (SELECT unnest(range(1, 6)) AS step)),
count_ AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (NOT regexp_matches(failed, upto)) AS kept,
         sum(n) FILTER (contains(failed, f) AND NOT regexp_matches(failed, before)) AS removed,
         sum(n) FILTER (contains(failed, f) AND regexp_matches(failed, before)) AS redundant,
         sum(n) FILTER (failed = f) AS unique_fails,
         sum(good) FILTER (contains(failed, f) AND NOT regexp_matches(failed, before)) AS good_lost,
         sum(toxic) FILTER (contains(failed, f) AND NOT regexp_matches(failed, before)) AS toxic_lost
  FROM cell, step GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM count_
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_exact_top_k": op2_exact_top_k, "op3_decontamination": op3_decontamination, "op4_near_duplicates": op4_near_duplicates, "op5_license_scan": op5_license_scan, "op6_token_counts": op6_token_counts, "op7_sentencepiece": op7_sentencepiece, "op8_suffix_array_dedup": op8_suffix_array_dedup, "op9_line_dedup": op9_line_dedup, "op10_html_extraction": op10_html_extraction, "op11_quality": op11_quality, "op12_spelling": op12_spelling, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op3_decontamination": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op8_suffix_array_dedup": OP8_SQL, "op12_spelling": OP12_SQL, "op13_filter_audit": OP13_SQL}
