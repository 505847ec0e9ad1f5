"""Streams over the given tables. Rows arrive in parts, one run of the stream for each: every run but the first goes on
from the checkpoint, as after a restart. A query returns what its stream has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.plans.tables import LAYERS, table
from hybridkb.sources import versions
from hybridkb.sources.staging import fresh_folder, stage
from hybridkb.streaming import ops

DAYS = 8  # of events in a part
LAST = 4  # the part behind the last of 30 days


def _stream(s, d, name):
    # As a pattern, the path may be a file as well as a folder of files.
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def _ended(query):
    query.awaitTermination()
    return query


def _arrive(rows: DataFrame, part: Column, parts: range, step: Callable[[DataFrame], None]) -> None:
    """Write the rows part by part to a folder, and run ``step`` on its stream behind each."""
    s = rows.sparkSession
    folder = fresh_folder(s, "arrivals")
    parted = stage(rows.withColumn("part", part), "parted")
    for n in parts:
        parted.where(F.col("part") == n).drop("part").write.mode("append").parquet(folder)
        step(s.readStream.schema(rows.schema).parquet(folder))


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _day() -> Column:
    return F.dayofyear("ts") - 1


def dedupe(s, d):
    files = _stream(s, d, "events").select(F.col("event_type").alias("layer"), F.col("user_id").cast("string").alias("path"), (F.floor("value") % 4).cast("string").alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    out, check = fresh_folder(s, "deduped"), fresh_folder(s, "deduped-state")
    once = ops.stream_dedupe(files, late="60 days").select("layer", "path", "content_hash")
    _ended(once.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
    return s.read.parquet(out)


def moves(s, d):
    e = _events(s, d).select("user_id", "event_id", F.col("event_type").alias("place"), "ts")
    out, check = fresh_folder(s, "moves"), fresh_folder(s, "moves-state")
    runs = iter(range(LAST))

    def step(stream):
        run = next(runs)

        def write(batch, batch_id):
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/run={run}-{batch_id}")

        with ops.rocksdb_state(s):
            found = ops.stream_moves(stream.drop("ts"))
            _ended(found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start())

    _arrive(e, F.floor(_day() / DAYS).cast("int"), range(LAST), step)
    last = F.max_by(F.struct("n_moves", "n_late", "current", "latest"), "batch")
    return s.read.parquet(out).groupBy("user_id").agg(last.alias("r")).select("user_id", "r.*")


def sessions(s, d):
    """Some events come a part too late: those of the day are behind the watermark, those around midnight are not. Behind
    the last part, a mark in the far future closes what is open."""
    e = _events(s, d).select("user_id", "event_id", "ts")
    end = e.agg(F.lit(None).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    slow = ((F.col("event_id") % 40 == 0) & (F.hour("ts") < 20)) | ((F.col("event_id") % 3 == 0) & (F.date_format("ts", "HH:mm") >= "23:50"))
    part = F.when(F.col("event_id") < 0, LAST + 1).otherwise(F.floor(_day() / DAYS).cast("int") + slow.cast("int"))
    out, check = fresh_folder(s, "sessions"), fresh_folder(s, "sessions-state")
    dropped = []

    def step(stream):
        query = ops.stream_sessions(stream.select("user_id", "ts")).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        dropped.append(ops.dropped_late(_ended(query.trigger(availableNow=True).start())))

    _arrive(e.unionByName(end), part, range(LAST + 2), step)
    closed = s.read.parquet(out).where("user_id IS NOT NULL")
    return closed.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_messages").alias("n_messages"), F.max("n_messages").alias("longest"), F.lit(sum(dropped)).cast("bigint").alias("n_late_rows"))


def ingest(s, d):
    """The documents arrive, and then again with every fifth one edited: what is the same stays as it came first."""
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.col("doc_id") % 3 + 1).cast("int"))
    folder = fresh_folder(s, "ingested")
    for run in (1, 2):
        text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")) if run == 2 else F.col("text")
        files = _stream(s, d, "documents").select(layer.alias("layer"), F.col("doc_id").cast("string").alias("path"), F.sha2(text, 256).alias("content_hash"), F.col("doc_id").alias("seq"), F.lit(run).alias("run"))
        _ended(ops.stream_ingest(files, folder, fresh_folder(s, "ingest-state")))
    return versions.read_table(s, folder).select("layer", "path", "content_hash", "run")


MOVED = "WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"


def entries() -> dict:
    """key: (query, SQL or None)."""
    return {
        "stream_dedupe": (dedupe, "SELECT DISTINCT event_type AS layer, CAST(user_id AS VARCHAR) AS path, CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS content_hash FROM events"),
        "stream_moves": (
            moves,
            f"{MOVED}, k AS (SELECT user_id, list(event_type ORDER BY event_id DESC) AS l FROM m WHERE before IS NULL OR before <> event_type GROUP BY 1) SELECT user_id, len(l) - 1 AS n_moves, CAST(0 AS BIGINT) AS n_late, l[1] AS current, l[2:4] AS latest FROM k",
        ),
        "stream_ingest": (ingest, "SELECT ['shared', 'community', 'vessel'][doc_id % 3 + 1] AS layer, CAST(doc_id AS VARCHAR) AS path, sha256(text || CASE WHEN doc_id % 5 = 0 THEN ' edited' ELSE '' END) AS content_hash, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS run FROM documents"),
        # The watermark of a part is an hour before the newest event of the parts before it.
        "stream_sessions": (
            sessions,
            """WITH e AS (SELECT *, (dayofyear(ts) - 1) // 8 + CASE WHEN (event_id % 40 = 0 AND hour(ts) < 20) OR (event_id % 3 = 0 AND strftime(ts, '%H:%M') >= '23:50') THEN 1 ELSE 0 END AS part FROM events),
            mark AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM e GROUP BY part),
            judged AS (SELECT e.*, coalesce(ts + INTERVAL 30 MINUTE <= mark, false) AS late FROM e JOIN mark USING (part)),
            x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM judged WHERE NOT late),
            y AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x),
            z AS (SELECT user_id, session, count(*) AS n FROM y GROUP BY ALL)
            SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_messages, max(n) AS longest, (SELECT count(DISTINCT (user_id, ts)) FROM judged WHERE late) AS n_late_rows FROM z GROUP BY user_id""",
        ),
    }
