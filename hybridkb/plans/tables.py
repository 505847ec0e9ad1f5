"""Engine tables made of the given tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ["shared", "community", "vessel"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """The documents as chunks. Searches that read no vectors leave the join with them out."""
    d = table(spark, sf_dir, "documents")
    n = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), F.coalesce(n, F.lit(0)) % 3 + 1)
    base = d.select(
        F.col("doc_id").alias("chunk_id"),
        "source",
        layer.alias("layer"),
        F.coalesce("text", F.lit("")).alias("content"),
        (F.col("doc_id") % 17 != 0).alias("is_active"),
        F.when((layer == "vessel") & (F.col("doc_id") % 7 == 0), F.col("doc_id") - 1).alias("supersedes_id"),
        F.when((layer == "vessel") & (F.col("doc_id") % 11 == 0), F.col("doc_id") - 2).alias("annotates_id"),
    )
    if not vectors:
        return base
    return base.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text")).join(e, "query_id", "left")


CHUNKS_SQL = r"""
chunks AS (
  SELECT d.doc_id AS chunk_id, source, layer, coalesce(text, '') AS content, d.doc_id % 17 <> 0 AS is_active,
         CASE WHEN layer = 'vessel' AND d.doc_id % 7 = 0 THEN d.doc_id - 1 END AS supersedes_id,
         CASE WHEN layer = 'vessel' AND d.doc_id % 11 = 0 THEN d.doc_id - 2 END AS annotates_id, embedding
  FROM (SELECT *, ['shared', 'community', 'vessel'][coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER), 0) % 3 + 1] AS layer FROM documents) d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
queries AS (
  SELECT item_id AS query_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' ') AS text, embedding
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)
"""

RETRIEVAL_SQL = CHUNKS_SQL + r""",
phrase AS (
  SELECT query_id, p - 1 AS phrase_no, list_filter(string_split_regex(lower(w[p]), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS terms
  FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT query_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM queries))),
qt AS (SELECT query_id, phrase_no, o - 1 AS off, terms[o] AS term, len(terms) AS phrase_len FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS o FROM phrase)),
tok AS (SELECT chunk_id, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM chunks),
stats AS (SELECT count(*) AS n_chunks, avg(len(t)) AS avg_len FROM tok),
posting AS (SELECT chunk_id, len(t) AS len, p - 1 AS pos, t[p] AS term FROM (SELECT chunk_id, t, unnest(range(1, len(t) + 1)) AS p FROM tok)),
start AS (
  SELECT query_id, phrase_no, phrase_len, chunk_id, len, pos - off AS at FROM posting JOIN qt USING (term)
  GROUP BY ALL HAVING count(*) = phrase_len),
tf AS (SELECT query_id, phrase_no, chunk_id, len, count(*) AS tf FROM start GROUP BY ALL),
df AS (SELECT query_id, phrase_no, count(*) AS df FROM tf GROUP BY ALL),
score AS (
  SELECT query_id, chunk_id, -sum(greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS score
  FROM tf JOIN df USING (query_id, phrase_no), stats GROUP BY ALL),
bm25 AS (
  SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank
                 FROM score JOIN chunks USING (chunk_id) WHERE is_active) WHERE rank <= 20),
dist AS (
  SELECT query_id, chunk_id, sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS distance
  FROM queries q JOIN chunks c ON is_active AND q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM dist) WHERE rank <= 20),
gate AS (
  SELECT query_id, (d IS NULL AND s IS NULL) OR (coalesce(s, 0) > -5.0 AND coalesce(d, 999) > 1.0) AS refused
  FROM queries LEFT JOIN (SELECT query_id, min(distance) AS d FROM knn GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, min(score) AS s FROM bm25 GROUP BY 1) USING (query_id)),
fused0 AS (
  SELECT query_id, chunk_id, k.rank AS knn_rank, b.rank AS bm25_rank, coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
  FROM knn k FULL JOIN bm25 b USING (query_id, chunk_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, knn_rank NULLS LAST, bm25_rank NULLS LAST) AS pos FROM fused0),
weighted AS (
  SELECT query_id, chunk_id, layer, score, score * CASE layer WHEN 'shared' THEN 1.2::DOUBLE WHEN 'community' THEN 1.0::DOUBLE WHEN 'vessel' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS weighted, pos AS pos0
  FROM fused LEFT JOIN (SELECT chunk_id, layer FROM chunks) USING (chunk_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weighted, 12) DESC, pos0) AS pos FROM weighted),
top5 AS (SELECT query_id, chunk_id, pos FROM ordered WHERE pos <= 5),
forced AS (
  SELECT b.query_id, b.chunk_id, CASE WHEN last >= 5 THEN 5 ELSE coalesce(last, 0) + 1 END AS pos
  FROM bm25 b JOIN queries q USING (query_id) LEFT JOIN (SELECT query_id, max(pos) AS last FROM top5 GROUP BY 1) s ON s.query_id = b.query_id
  WHERE b.rank = 1 AND (b.score <= -5.0 OR regexp_matches(q.text, '["0-9A-Z]|[A-Za-z0-9][-/][A-Za-z0-9]'))
    AND NOT EXISTS (SELECT 1 FROM top5 t WHERE t.query_id = b.query_id AND t.chunk_id = b.chunk_id)),
slot AS (
  SELECT * FROM top5 t WHERE NOT EXISTS (SELECT 1 FROM forced f WHERE f.query_id = t.query_id AND f.pos = 5 AND t.pos = 5)
  UNION ALL SELECT * FROM forced),
pool AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(p)) AS pos
  FROM (SELECT query_id, chunk_id, pos AS p FROM ordered WHERE pos <= 20 UNION ALL SELECT query_id, chunk_id, rank + 20 FROM bm25) GROUP BY query_id, chunk_id),
edge AS (
  SELECT query_id, chunk_id AS vessel_id, supersedes_id AS target_id, 'supersede' AS relation FROM pool JOIN chunks USING (chunk_id) WHERE layer = 'vessel' AND is_active
  UNION ALL SELECT query_id, chunk_id, annotates_id, 'annotate' FROM pool JOIN chunks USING (chunk_id) WHERE layer = 'vessel' AND is_active),
pairs AS (
  SELECT query_id, target_id, vessel_id, relation FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.query_id, target_id ORDER BY relation DESC, CASE WHEN relation = 'supersede' THEN -vessel_id ELSE vessel_id END) AS nth
    FROM edge e JOIN pool t ON t.query_id = e.query_id AND t.chunk_id = e.target_id) WHERE nth = 1)
"""

# The same with the lists after the overrides have come in.
WHOLE_SQL = RETRIEVAL_SQL + r""",
link AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relation DESC, target_id) AS k FROM pairs),
listed AS (SELECT query_id, list(chunk_id ORDER BY pos) AS ids FROM slot GROUP BY query_id),
named AS (SELECT query_id, flatten(list([target_id, vessel_id])) AS named FROM link GROUP BY query_id),
wanted AS (
  SELECT query_id, new, row_number() OVER (PARTITION BY query_id ORDER BY k) AS k FROM (
    SELECT query_id, k, CASE WHEN list_contains(ids, target_id) AND NOT list_contains(ids, vessel_id) THEN vessel_id
                             WHEN list_contains(ids, vessel_id) AND NOT list_contains(ids, target_id) THEN target_id END AS new
    FROM link JOIN listed USING (query_id)) WHERE new IS NOT NULL),
pulled(query_id, k, ids) AS (
  SELECT query_id, CAST(0 AS BIGINT), ids FROM listed
  UNION ALL
  SELECT p.query_id, w.k, CASE
      WHEN list_contains(p.ids, w.new) THEN p.ids
      WHEN len(p.ids) < 5 OR len(list_filter(p.ids, lambda x: NOT list_contains(n.named, x))) = 0 THEN list_append(p.ids, w.new)
      ELSE list_transform(range(1, len(p.ids) + 1), lambda i: CASE WHEN i = list_max(list_filter(range(1, len(p.ids) + 1), lambda j: NOT list_contains(n.named, p.ids[j]))) THEN w.new ELSE p.ids[i] END) END
  FROM pulled p JOIN wanted w ON w.query_id = p.query_id AND w.k = p.k + 1 JOIN named n ON n.query_id = p.query_id),
working AS (
  SELECT query_id, unnest(ids) AS chunk_id, unnest(range(1, len(ids) + 1)) AS pos
  FROM (SELECT query_id, max_by(ids, k) AS ids FROM pulled GROUP BY query_id)),
final AS (
  SELECT query_id, chunk_id, pos, CASE WHEN relation IS NULL THEN '' ELSE ' [NOTE: ' || relation || 'd by vessel note]' END AS note FROM (
    SELECT w.query_id, w.chunk_id, relation, row_number() OVER (PARTITION BY w.query_id ORDER BY relation IS NOT NULL, w.pos) AS pos FROM working w
    LEFT JOIN (SELECT p.* FROM pairs p JOIN working v ON v.query_id = p.query_id AND v.chunk_id = p.vessel_id) a ON a.query_id = w.query_id AND a.target_id = w.chunk_id)
  WHERE pos <= 5)
"""
