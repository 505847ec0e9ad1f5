"""Streams: change-only ingest, sessions, deduplication and location moves."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hybridkb.sources.staging import stage
from hybridkb.sources.versions import publish_changes

LATEST = 3  # places that an item's state remembers besides the current one
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ingest(files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Publish every micro-batch of files (layer, path, content_hash, seq and others) to the versioned table in
    ``folder``: of a path's rows in a batch the one with the largest ``seq``, and of these what is new or changed. A
    batch that is run again after a failure finds its rows stored, and publishes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rest = F.struct(*[c for c in batch.columns if c not in ("layer", "path")])
        latest = batch.groupBy("layer", "path").agg(F.max_by(rest, "seq").alias("r")).select("layer", "path", "r.*")
        publish_changes(stage(latest, "arrived"), folder)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(messages: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n_messages: session windows in event time, each once it can no longer grow. A message that
    ends its own gap before the watermark is dropped; ``dropped_late`` counts these."""
    return messages.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_messages")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_messages")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that the query's state operators have dropped behind the watermark, over its recent progress."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def stream_dedupe(files: DataFrame, late: str = "1 day") -> DataFrame:
    """The same content of the same path once within the watermark."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["layer", "path", "content_hash"])


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, outside of the heap; the setting is put back behind."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Moves(StatefulProcessor):
    """Where an item is, how often it moved, and the places before."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One state, so that a key costs one call to read and one to write.
        self.now = handle.getValueState("now", "place string, event_id bigint, n_moves bigint, n_late bigint, before array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place, last, n_moves, n_late, before = self.now.get() or (None, None, 0, 0, [])
        # A key's rows of one micro-batch; the source's limit for a trigger bounds them.
        arrived = sorted(((r["event_id"], r["place"]) for r in rows), key=lambda r: (r[0] is None, r[0]))
        for event_id, where in arrived:
            if event_id is None or (last is not None and event_id <= last):
                n_late += 1
                continue
            if last is None:
                place = where
            elif where != place:
                before, place, n_moves = [place, *before][:LATEST], where, n_moves + 1
            last = event_id
        before = list(before)
        self.now.update((place, last, n_moves, n_late, before))
        yield Row(user_id=key[0], n_moves=n_moves, n_late=n_late, current=place, latest=before)

    def close(self) -> None:
        pass


def stream_moves(moves: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """user_id, n_moves, n_late, current, latest for the items (user_id) that a micro-batch has rows of (event_id, place).
    Rows of a batch count in the order of event_id; one that is not newer than what its item has seen in earlier
    batches, or has no event_id, changes nothing and is counted as late. Start it inside ``rocksdb_state``. With ``ttl_ms``, an item
    without rows for so long is forgotten."""
    out = "user_id bigint, n_moves bigint, n_late bigint, current string, latest array<string>"
    return moves.groupBy("user_id").transformWithState(Moves(ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None")
