"""Exact removal of repeated byte strings: run-length indexes and streamed matching statistics.

A byte goes if a string of ``length`` (100) bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in the same one. The corpus is cut so that no index ever holds more than a bounded
share of it:

1. Every string of 100 bytes has an anchor, its leftmost 36-byte substring of least hash. The strings that
   share one anchor occurrence form a segment (some 30 strings, at most 164 bytes). Equal strings have equal
   anchors, so they only ever meet in segments of equal anchors.
2. Segments that are equal as a whole (by two hashes, of the anchor and of all bytes, the latter modulo a prime) are
   one text with several places: the first stays, later ones go. A batch settles its own first, so a passage that a third of
   all documents hold reaches the shuffle once for each batch; buckets of hashes with very many rows are dealt
   over salts.
3. The different segments of anchors that have several (the ends of copied passages, edits) are gathered by
   anchor. Group by group, in rounds of halves, a run-length BWT index of the earlier halves is built and the
   later halves are streamed over it; where the matching statistic is 100 or more, the string starts earlier.
   Matching statistics compare bytes. Segments of which no string occurs twice in the group, by hash, have no
   match and stay out of the index.
4. An anchor whose different segments exceed INDEX_BYTES is never one group: its segments are cut again by a
   longer anchor, and so on; at the latest an anchor as long as the strings tells all different ones apart.
5. The removed spans of a document are merged.

Null text is empty. Rows that repeat doc_id and text, or have no doc_id and the same text, are one document. Rows
that share a doc_id but not the text are different documents, in the order of a hash of their texts; those without
doc_id come last, in that order too.
Texts shorter than 100 bytes lose nothing; very long texts are read in pieces that overlap. Empty tables give empty
results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.llm.common import (
    BROADCAST_ROWS,
    GOLDEN,
    discard,
    field_hash,
    field_span,
    mix64,
    powers,
    prefix_hash,
    slices_by_bytes,
    span_hash,
    text_buffers,
    tidy,
    write_out,
)
from hybridkb.llm.run_length_index import RunLengthIndex

ANCHOR = 36
SLAB = 2 << 20
PIECE = 1 << 19  # of a slab that is hashed at a time
INDEX_BYTES = 2 << 20  # of segments of one anchor that one index is built for
GROUP_BYTES = 1 << 19  # of segments of several anchors that share one index
HASH_BUCKETS = 1 << 16
HOT, SALTS = 100_000, 64  # rows of a bucket of hashes beyond twice the mean that are dealt over salts
BROADCAST_BYTES = 32 << 20
LARGEST = 2**63 - 1
LOW = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, width: int = ANCHOR):
    """For each occurrence of an anchor of ``width`` bytes: its place, the first and last start of its strings,
    anchor hash, hash of all."""
    n, w = len(data), length - width + 1
    none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < length:
        return none, none, none, hashes, hashes
    h = prefix_hash(data)
    # Hashes of all such substrings as in span_hash, in place: a batch's arrays are the memory of a task.
    order = h[width:] - h[:-width]
    order *= powers(n + 1)[1][: len(order)]
    order += np.uint64(width * int(GOLDEN) % 2**64)
    order = mix64(order)
    order &= ~LOW
    order |= np.arange(len(order), dtype=np.uint64)
    end = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))
    order[np.arange(width, n + 1, dtype=np.int32) > end[: len(order)]] |= ~LOW
    least, size = order, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = len(order) - w + 1
    least = np.minimum(least[:m], least[w - size : w - size + m])
    start = np.flatnonzero(np.arange(length, length + m, dtype=np.int32) <= end[:m])
    if not len(start):
        return none, none, none, hashes, hashes
    place = (least[start] & LOW).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    lo, hi, place = start[cut], start[np.concatenate((cut[1:], [len(start)])) - 1], place[cut]
    anchor = span_hash(h, place, place + width)
    del h, order, least, end, start
    return place, lo, hi, anchor, field_span(field_hash(data), lo, hi + length)


def segments_by_pieces(data: np.ndarray, offsets: np.ndarray, length: int, width: int = ANCHOR):
    """``segments``, hashed some texts at a time, as the hashes take some eighty times the bytes that they are of. A long
    text is cut with an overlap; segments at the cuts are shorter, and hold the same strings."""
    found = [segments(data[:0], np.zeros(1, np.int64), length, width)]
    for at, n in slices_by_bytes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]), PIECE):
        a, b = int(offsets[at]), int(offsets[at + n])
        if n > 1 or b - a <= 2 * PIECE:
            cuts = [(a, offsets[at : at + n + 1] - a)]
        else:
            cuts = [(x, np.array([0, min(PIECE + length - 1, b - x)])) for x in range(a, b - length + 1, PIECE)]
        for base, ends in cuts:
            place, lo, hi, anchor, whole = segments(data[base : base + ends[-1]], ends, length, width)
            found.append((place + base, lo + base, hi + base, anchor, whole))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slabs(batch: pa.RecordBatch, column: int, length: int):
    """(first row, rows, bytes, offsets, base): pieces of at most a few MB; a long text is cut with an overlap."""
    for at, n in slices_by_bytes(batch.column(column), SLAB):
        data, offs = text_buffers(batch.column(column).slice(at, n))
        if len(data) <= 2 * SLAB or n > 1:
            yield at, n, data, offs, 0
        else:
            for base in range(0, len(data) - length + 1, SLAB):
                piece = data[base : base + SLAB + length - 1]
                yield at, 1, piece, np.array([0, len(piece)]), base


def _first_of(hashes: np.ndarray, anchor: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest occurrence of each hash, and of others that have its anchor too."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_hash = np.argsort(hashes)
    edge = np.concatenate(([True], hashes[by_hash][1:] != hashes[by_hash][:-1], [True]))
    alone = edge[:-1] & edge[1:]
    some = by_hash[~alone]
    order = some[np.lexsort((start[some], rid[some], doc[some], anchor[some], hashes[some]))]
    change = lambda x: x[order][1:] != x[order][:-1]
    lead = np.concatenate(([True], change(hashes) | change(anchor))) if len(order) else np.zeros(0, bool)
    return np.concatenate((by_hash[alone], order[lead])), order[~lead]


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of [lo, hi) by row."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    wide = int(hi.max()) + 1
    top = np.maximum.accumulate(hi + row * wide) - row * wide
    fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > top[:-1])))
    at = np.flatnonzero(fresh)
    return row[at], lo[at], top[np.concatenate((at[1:], [len(row)])) - 1]


def _documents(documents: DataFrame) -> DataFrame:
    """doc (LARGEST without doc_id), rid (a hash of the text, another one without doc_id), text, doc_id."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("bigint")
    rid = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(text))
    return documents.select(F.coalesce(doc_id, F.lit(LARGEST)).alias("doc"), rid.alias("rid"), text.alias("text"), doc_id.alias("doc_id"))


def _long_column(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def scan_segments(documents: DataFrame, length: int) -> DataFrame:
    """doc, rid, anchor, whole, lo, hi: one row for each different segment of a batch; and with a null anchor,
    the merged spans that the batch already knows to be later copies."""

    def scan(batches):
        for batch in tidy(batches):
            doc_all, rid_all = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, n, data, offs, base in _slabs(batch, 2, length):
                _, lo, hi, anchor, whole = segments_by_pieces(data, offs, length)
                row = np.searchsorted(offs, lo, side="right") - 1
                lo, hi = lo - offs[row] + base, hi + length - offs[row] + base
                first, later = _first_of(whole, anchor, doc_all[at + row], rid_all[at + row], lo)
                r, a, b = _merged(row[later], lo[later], hi[later])
                rows = np.concatenate([row[first], r]) + at
                nulls = np.arange(len(rows)) >= len(first)
                pad = np.zeros(len(r), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_all[rows]),
                        pa.array(rid_all[rows]),
                        pa.array(np.concatenate([anchor[first].view(np.int64), pad]), mask=nulls),
                        pa.array(np.concatenate([whole[first].view(np.int64), pad]), mask=nulls),
                        pa.array(np.concatenate([lo[first], a]).astype(np.int32)),
                        pa.array(np.concatenate([hi[first], b]).astype(np.int32)),
                    ],
                    names=["doc", "rid", "anchor", "whole", "lo", "hi"],
                )

    return _documents(documents).drop("doc_id").mapInArrow(scan, "doc bigint, rid bigint, anchor bigint, whole bigint, lo int, hi int")


def shared_anchor_texts(documents: DataFrame, bloom, length: int) -> DataFrame:
    """doc, rid, anchor, whole, lo, at (place of the anchor), body: the segments whose anchor may be shared by
    different segments, one row for each different segment of a batch."""
    shared = documents.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches):
        bits = shared.value
        for batch in tidy(batches):
            doc_all, rid_all = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, n, data, offs, base in _slabs(batch, 2, length):
                _, lo, hi, anchor, whole = segments_by_pieces(data, offs, length)
                keep = _in_bloom(bits, anchor) if len(anchor) else np.zeros(0, bool)
                lo, hi, anchor, whole = lo[keep], hi[keep] + length, anchor[keep], whole[keep]
                row = np.searchsorted(offs, lo, side="right") - 1
                first, _ = _first_of(whole, anchor, doc_all[at + row], rid_all[at + row], lo - offs[row] + base)
                row, lo, hi = row[first], lo[first], hi[first]
                bodies = [data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_all[at + row]),
                        pa.array(rid_all[at + row]),
                        _long_column(anchor[first]),
                        _long_column(whole[first]),
                        pa.array((lo - offs[row] + base).astype(np.int32)),
                        pa.array(bodies, type=pa.binary()),
                    ],
                    names=["doc", "rid", "anchor", "whole", "lo", "body"],
                )

    return _documents(documents).drop("doc_id").mapInArrow(scan, "doc bigint, rid bigint, anchor bigint, whole bigint, lo int, body binary")


BLOOM_BITS = 26  # 8 MB, whatever the size of the corpus: it only saves work


def _slots(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) >> np.uint64(64 - BLOOM_BITS)


def _in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _slots(keys)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _bloom(anchors: DataFrame) -> np.ndarray:
    """A bit for each shared anchor; at most 2 ** (BLOOM_BITS - 6) words come to the driver."""
    word = F.shiftrightunsigned("anchor", 64 - BLOOM_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - BLOOM_BITS}) & 63 AS int))")
    got = anchors.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _repeating(bodies: list[bytes], length: int) -> np.ndarray:
    """Which segments hold a string that another one may hold as well, by hash: all that the index must see."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    h = prefix_hash(np.frombuffer(b"".join(bodies), dtype=np.uint8))
    n = sizes - length + 1
    seg = np.repeat(np.arange(len(n)), n)
    begin = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())
    _, back, count = np.unique(span_hash(h, begin, begin + length), return_inverse=True, return_counts=True)
    keep = np.zeros(len(n), dtype=bool)
    keep[seg[count[back] > 1]] = True
    return np.flatnonzero(keep)


def _later_by_index(bodies: list[bytes], group: np.ndarray, length: int) -> np.ndarray:
    """(segment, start, stop) rows, merged: strings of segments that an earlier segment of the group holds.
    Segments are sorted by group and order; groups are halved again and again, all in step."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    ends = np.cumsum(sizes)
    found_seg, found_at = [], []
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    if not len(bodies):
        return np.zeros((0, 3), np.int64)
    spans = [(a, b, a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]
    plain = data.astype(np.int32) + 1
    while spans:
        # Spans of one group are families of their own, so that none is held against a later span.
        family = np.zeros(len(bodies), dtype=np.int32)
        seen: dict[int, int] = {}
        for a, b, g in spans:
            family[a:b] = seen[g] = seen.get(g, -1) + 1
        symbols = plain + 256 * np.repeat(family, sizes)
        halves = [(a, (a + b) // 2, b) for a, b, _ in spans]
        left = np.concatenate([np.arange(a, m) for a, m, _ in halves])
        right = np.concatenate([np.arange(m, b) for _, m, b in halves])
        n = sizes[left] + 1
        text = np.zeros(n.sum(), dtype=np.int32)
        shift = np.repeat(ends[left] - sizes[left] - (np.cumsum(n) - n), n)
        at = np.arange(len(text))
        inner = np.ones(len(text), bool)
        inner[np.cumsum(n) - 1] = False
        text[inner] = symbols[(at + shift)[inner]]
        index = RunLengthIndex(text, int(sizes[left].max()))
        for live, start, match in index.matching(symbols, ends[right], sizes[right], length):
            hit = match >= length
            if hit.any():
                found_seg.append(right[live[hit]])
                found_at.append(start[hit])
        spans = [s for a, b, g in spans for s in ((a, (a + b) // 2, g), ((a + b) // 2, b, g)) if s[1] - s[0] > 1]
    if not found_seg:
        return np.zeros((0, 3), np.int64)
    seg, at = np.concatenate(found_seg), np.concatenate(found_at)
    return np.stack(_merged(seg, at, at + length), axis=1)


def _settle_groups(shared: DataFrame, length: int) -> DataFrame:
    """doc, rid, lo, hi: later strings among the different segments of an anchor, by run-length indexes."""

    def settle(batches):
        held: list[pa.RecordBatch] = []
        pending = 0

        def flush(rows: list[pa.RecordBatch], final: bool):  # segments of one anchor stay together
            table = pa.Table.from_batches(rows)
            keys = table.column("anchor").to_numpy()
            stop = len(keys) if final else int(np.flatnonzero(keys != keys[-1])[-1] + 1) if (keys != keys[-1]).any() else 0
            rest = table.slice(stop).combine_chunks().to_batches()
            table = table.slice(0, stop)
            if not stop:
                return None, rest
            bodies = table.column("body").to_pylist()
            kept = _repeating(bodies, length)
            spans = _later_by_index([bodies[i] for i in kept.tolist()], keys[kept], length)
            seg = kept[spans[:, 0]]
            doc, rid, lo = (table.column(c).to_numpy() for c in ("doc", "rid", "lo"))
            out = pa.RecordBatch.from_arrays(
                [pa.array(doc[seg]), pa.array(rid[seg]), pa.array((lo[seg] + spans[:, 1]).astype(np.int32)), pa.array((lo[seg] + spans[:, 2]).astype(np.int32))],
                names=["doc", "rid", "lo", "hi"],
            )
            return out, rest

        for batch in tidy(batches):
            for at, n in slices_by_bytes(batch.column(4), GROUP_BYTES):
                held.append(batch.slice(at, n))
                pending += held[-1].nbytes
                if pending > GROUP_BYTES:
                    out, held = flush(held, final=False)
                    pending = sum(b.nbytes for b in held)
                    if out is not None:
                        yield out
        if held:
            out, _ = flush(held, final=True)
            if out is not None:
                yield out

    by_anchor = shared.select("doc", "rid", "anchor", "lo", "body").repartition("anchor").sortWithinPartitions("anchor", "doc", "rid", "lo")
    return by_anchor.mapInArrow(settle, "doc bigint, rid bigint, lo int, hi int")


def _later_equals(rows: DataFrame) -> DataFrame:
    """doc, rid, lo, hi: all but the first of the rows that share anchor and hash of all."""
    place = ["doc", "rid", "lo"]
    nth = lambda *keys: F.row_number().over(Window.partitionBy("anchor", "whole", *keys).orderBy(*place))
    bucket = F.col("whole").bitwiseAND(HASH_BUCKETS - 1)
    limit = 2 * rows.count() // HASH_BUCKETS + HOT
    heavy = write_out(rows.groupBy(bucket.alias("heavy")).count().where(F.col("count") > limit).select("heavy"), "heavy")
    rows = rows.select(*place, "hi", "anchor", "whole")
    if heavy.isEmpty():
        return rows.withColumn("nth", nth()).where("nth > 1").select(*place, "hi")
    # HASH_BUCKETS rows at most are broadcast.
    dealt = rows.join(F.broadcast(heavy), bucket == F.col("heavy"), "left")
    salt = F.when(F.col("heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*place), F.lit(SALTS)))
    dealt = write_out(dealt.withColumn("salt", salt).withColumn("nth", nth("salt")).where("nth > 1 OR salt > 0").drop("heavy"), "dealt")
    again = dealt.where("nth = 1").withColumn("nth", nth())
    return dealt.where("nth > 1").select(*place, "hi").unionByName(again.where("nth > 1").select(*place, "hi"))


def _finer_segments(texts: DataFrame, length: int, width: int) -> DataFrame:
    """doc, rid, anchor, whole, lo, hi, body: segments cut again by anchors of ``width`` bytes."""

    def cut(batches):
        for batch in tidy(batches):
            for at, n in slices_by_bytes(batch.column(3), SLAB):
                bodies = batch.column(3).slice(at, n)
                data, offs = text_buffers(bodies)
                doc, rid, place = (batch.column(i).slice(at, n).to_numpy(zero_copy_only=False) for i in range(3))
                _, lo, hi, anchor, whole = segments_by_pieces(data, offs, length, width)
                hi = hi + length
                row = np.searchsorted(offs, lo, side="right") - 1
                found = [data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                spans = ((place[row] + x - offs[row]).astype(np.int32) for x in (lo, hi))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[row]), pa.array(rid[row]), _long_column(anchor), _long_column(whole), *map(pa.array, spans), pa.array(found, type=pa.binary())],
                    names=["doc", "rid", "anchor", "whole", "lo", "hi", "body"],
                )

    return texts.select("doc", "rid", "lo", "body").mapInArrow(cut, "doc bigint, rid bigint, anchor bigint, whole bigint, lo int, hi int, body binary")


def _first_texts(texts: DataFrame) -> DataFrame:
    """doc, rid, lo, anchor, body: the first of the rows that share anchor and hash of all."""
    first = F.min(F.struct("doc", "rid", "lo", "body"))
    return texts.groupBy("anchor", "whole").agg(first.alias("s")).select("s.doc", "s.rid", "s.lo", "anchor", "s.body")


def removed_spans(documents: DataFrame, length: int = 100) -> DataFrame:
    """doc, rid, spans: the merged [lo, hi) byte spans to remove (pairs of 32-bit integers), for documents that have any."""
    found = write_out(scan_segments(documents, length), "segments")
    known = found.where("anchor IS NULL").select("doc", "rid", "lo", "hi")
    alive = found.where("anchor IS NOT NULL")
    # After the batches' own work a segment has a row for each batch at most.
    copies = [write_out(known.unionByName(_later_equals(alive)), "copies")]
    shared = alive.groupBy("anchor").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("anchor")
    shared = write_out(shared, "shared")
    discard(found)
    texts = shared_anchor_texts(documents, _bloom(shared), length)
    texts = write_out(_first_texts(texts.hint("shuffle_merge").join(shared, "anchor", "left_semi")), "texts")
    width = ANCHOR
    while True:
        crowded = texts.groupBy("anchor").agg(F.sum(F.length("body")).alias("size")).where(F.col("size") > INDEX_BYTES)
        crowded = write_out(crowded.select("anchor"), "crowded")
        n = crowded.count()
        few = "broadcast" if n <= BROADCAST_ROWS else "shuffle_merge"
        copies.append(_settle_groups(texts.join(crowded.hint(few), "anchor", "left_anti") if n else texts, length))
        if not n or width == length:
            break
        copies[-1] = write_out(copies[-1], "copies")
        width = (width + length + 1) // 2
        finer = write_out(_finer_segments(texts.join(crowded.hint(few), "anchor", "left_semi"), length, width), "finer")
        copies.append(write_out(_later_equals(finer), "copies"))
        left = write_out(_first_texts(finer), "texts")
        discard(texts, finer)
        texts = left
    spans = reduce(DataFrame.unionByName, copies)
    grouped = spans.groupBy("doc", "rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def merge(batches):
        for batch in batches:
            lists = batch.column(2)
            s = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            row, lo, hi = _merged(row, *(s.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in (0, 1)))
            pairs = np.stack([lo, hi], axis=1).astype(np.int32)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [pairs[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, type=pa.binary())], names=["doc", "rid", "spans"])

    return grouped.mapInArrow(merge, "doc bigint, rid bigint, spans binary")


def remove_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every document."""
    spans = write_out(removed_spans(documents, length), "spans").select(F.col("doc").alias("_doc"), F.col("rid").alias("_rid"), "spans")
    rows, size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("spans")), F.lit(0))).first()
    hint = "broadcast" if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else "shuffle_merge"
    joined = _documents(documents).join(spans.hint(hint), (F.col("doc") == F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            removed, count, kept = [], [], []
            data, offs = text_buffers(batch.column(1))
            for i, spans in enumerate(batch.column(2)):
                body = data[offs[i] : offs[i + 1]]
                if not spans.is_valid:
                    removed.append(0)
                    count.append(0)
                    kept.append(body.tobytes())
                    continue
                lo, hi = np.frombuffer(spans.as_buffer(), dtype=np.int32).astype(np.int64).reshape(-1, 2).T
                removed.append(int((hi - lo).sum()))
                count.append(len(lo))
                edges = np.concatenate(([0], np.stack([lo, hi], axis=1).ravel(), [len(body)]))
                kept.append(b"".join(body[a:b].tobytes() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, type=pa.int64()), pa.array(count, type=pa.int64()), pa.array(kept, type=pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
