"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item with fewer words is one
window). A window's set is its shingles of three words, and only full containment counts, so the prefix
that a match cannot miss is a single shingle: the rarest one of the window, by its count over all
documents. Steps:

1. One pass over the documents finds the runs of words whose shingles occur in the benchmark at all (a
   Bloom filter of at most 2 ** MAX_BLOOM_BITS bits) and writes each document's word count, the shingles of
   its runs, and the runs' words in pieces of some PIECE words. Every occurrence of a window lies inside one run.
2. Shingles are ordered by rarity over those runs; every window joins on its rarest shingle. The offset of
   the shingle in the window gives the only possible start; a window that would begin before the run or end
   behind it is dropped (the positional and length bounds). No words travel with the shingles.
3. The candidates that are left meet the piece in which they begin, and the words themselves are compared.
4. Verified occurrences are merged per document.

Shingles that stand more than HOT times in the runs are dealt over several salts, and only their windows are copied.

Rows: null text counts as empty; an item or document without words takes no part, and such a document is
reported with zeros. Very long texts are whole: their runs are as many pieces as they need. Repeated rows are
reported once each. Items with a null id mark words but are not listed; repeated items count once. Extra
columns, whatever their names, are ignored by ``contamination_report`` and kept by ``drop_contaminated``. Empty
tables give empty reports; with an empty benchmark nothing is contaminated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import (
    ASCII_LOWER,
    BASE,
    BROADCAST_ROWS,
    mix64,
    field_hash,
    separators,
    shingle_hashes,
    slices_by_bytes,
    field_span,
    text_buffers,
    tidy,
    word_spans,
    write_out,
)
from hybridkb.llm.verdicts import keep_without

WORD_SEPARATORS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SHINGLE = 3
MIN_BLOOM_BITS, MAX_BLOOM_BITS = 20, 29  # 16 bits a shingle between these bounds: 64 MB at most
HOT = 20_000  # occurrences of a shingle that go to one salt
PIECE = 64  # starts of windows that one piece of a run serves
CHUNK = 1 << 19

KEY = "struct<pos:int,hash:bigint,run_start:int,run_stop:int>"
WORDS = "struct<run_start:int,block:int,first:int,text:string>"


def _words(data: np.ndarray, offsets: np.ndarray):
    lower = ASCII_LOWER[data]
    starts, ends, first = word_spans(lower, offsets, WORD_SEPARATORS)
    return lower, starts, ends, first, field_span(field_hash(lower), starts, ends)


def _keys(words: np.ndarray, k: int) -> np.ndarray:
    return mix64(shingle_hashes(words, k) ^ np.uint64(k))


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return keys >> shift, mix64(keys * BASE) >> shift


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, text (the window's words), n_words, keys(off, hash): one row per distinct window of an item."""
    schema = "item_id string, text string, n_words int, keys array<struct<off:int,hash:bigint>>"

    def cut(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            lower, s, e, first, h = _words(data, offs)
            rows = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                if a == b:
                    continue
                words = [bytes(lower[x:y]).decode("utf-8", "replace") for x, y in zip(s[a:b], e[a:b], strict=True)]
                size = min(window, b - a)
                k = min(SHINGLE, b - a)
                keys = _keys(h[a:b], k).view(np.int64)
                for w in range(b - a - size + 1):
                    rows.append((item, " ".join(words[w : w + size]), size, [{"off": j, "hash": int(keys[w + j])} for j in range(size - k + 1)]))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("off", pa.int32()), ("hash", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, kinds, strict=True)], names=["item_id", "text", "n_words", "keys"])

    out = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)
    return out.dropDuplicates(["item_id", "text"])


def _bloom(windows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The Bloom filter's words, its size as a power of two, and the shingle sizes in use."""
    keys = windows.select(F.explode("keys.hash").alias("h"), F.least(F.col("n_words"), F.lit(SHINGLE)).alias("k"))
    different = keys.groupBy("h", "k").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # SHINGLE rows at most
    size = min(max(int(16 * sum(r["n"] for r in different)).bit_length(), MIN_BLOOM_BITS), MAX_BLOOM_BITS)

    def bits(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            both = np.unique(np.concatenate(_probes(h, size)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((both >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (both & np.uint64(63))).view(np.int64))], names=["slot", "bits"]
            )

    filled = np.zeros(1 << (size - 6), dtype=np.uint64)
    got = keys.select("h").distinct().mapInArrow(bits, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return filled, size, sorted(r["k"] for r in different)


def document_runs(documents: DataFrame, bloom: np.ndarray, bloom_bits: int, sizes: list[int], window: int) -> DataFrame:
    """uid, doc_id, n_words, keys, pieces: for each document the shingles in the maximal runs of words in
    benchmark shingles, and the runs' words. A piece holds the words of all windows that begin in its block."""
    shared = documents.sparkSession.sparkContext.broadcast(bloom)
    schema = f"uid bigint, doc_id bigint, n_words bigint, keys array<{KEY}>, pieces array<{WORDS}>"
    piece_type = pa.list_(pa.struct([("run_start", pa.int32()), ("block", pa.int32()), ("first", pa.int32()), ("text", pa.string())]))

    def scan(batches):
        bits = shared.value
        uid = TaskContext.get().partitionId() << 33
        for whole in tidy(batches):
            for at, n in slices_by_bytes(whole.column(1), CHUNK):
                batch = whole.slice(at, n)
                data, offs = text_buffers(batch.column(1))
                lower, s, e, first, h = _words(data, offs)
                found = []
                marks = np.zeros(len(s) + 1, dtype=np.int32)
                doc = np.repeat(np.arange(n), np.diff(first))
                for k in sizes:
                    keys = _keys(h, k)
                    a, b = _probes(keys, bloom_bits)
                    hit = (bits[a >> np.uint64(6)] >> (a & np.uint64(63))) & (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)
                    at_word = np.flatnonzero(hit.astype(bool))
                    at_word = at_word[doc[at_word] == doc[at_word + k - 1]]
                    np.add.at(marks, at_word, 1)
                    np.add.at(marks, at_word + k, -1)
                    found.append((at_word, keys[at_word].view(np.int64)))
                covered = np.cumsum(marks[:-1]) > 0
                cut = np.ones(len(s) + 1, dtype=bool)
                cut[1:-1] = doc[1:] != doc[:-1]
                left, right = np.zeros(len(s), bool), np.zeros(len(s), bool)
                left[1:], right[:-1] = covered[:-1], covered[1:]
                opens = np.flatnonzero(covered & (~left | cut[:-1]))
                closes = np.flatnonzero(covered & (~right | cut[1:])) + 1
                pieces: list[list] = [[] for _ in range(n)]
                for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
                    d = int(doc[a])
                    base = int(first[d])
                    for block in range((a - base) // PIECE, (b - 1 - base) // PIECE + 1):
                        x, y = max(a, base + block * PIECE), min(b, base + (block + 1) * PIECE + window - 1)
                        text = " ".join(bytes(lower[i:j]).decode("utf-8", "replace") for i, j in zip(s[x:y].tolist(), e[x:y].tolist(), strict=True))
                        pieces[d].append({"run_start": a - base, "block": block, "first": x - base, "text": text})
                places, hashes = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
                order = np.argsort(places, kind="stable")
                places, hashes = places[order], hashes[order]
                base = first[doc[places]]
                run = np.searchsorted(opens, places, side="right") - 1
                kinds = (np.int32, np.int64, np.int32, np.int32)
                fields = [pa.array(v.astype(t)) for v, t in zip((places - base, hashes, opens[run] - base, closes[run] - base), kinds, strict=True)]
                keyed = pa.StructArray.from_arrays(fields, names=["pos", "hash", "run_start", "run_stop"])
                ends = np.searchsorted(places, first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), batch.column(0), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends), keyed), pa.array(pieces, type=piece_type)],
                    names=["uid", "doc_id", "n_words", "keys", "pieces"],
                )
                uid += n

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def occurrences(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """uid, item_id, start, size: every verified occurrence of a window in a document."""
    keyed = runs.select("uid", F.explode("keys").alias("key")).select("uid", "key.*")
    rarity = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n_seen"))
    parts = windows.select("item_id", "text", "n_words", F.size("keys").alias("n_keys"), F.explode("keys").alias("key")).select(
        "item_id", "text", "n_words", "n_keys", F.col("key.off").alias("off"), F.col("key.hash").alias("hash")
    )
    # A window with a shingle that no document has cannot occur; of the others, the rarest shingle is the prefix.
    prefix = write_out(
        parts.hint("shuffle_merge")
        .join(rarity, "hash")
        .groupBy("item_id", "text", "n_words", "n_keys")
        .agg(F.count(F.lit(1)).alias("n_found"), F.min(F.struct("n_seen", "hash", "off")).alias("rarest"))
        .where("n_found = n_keys")
        .select("item_id", "text", "n_words", F.col("rarest.hash").alias("hash"), F.col("rarest.off").alias("off"), F.ceil(F.col("rarest.n_seen") / HOT).cast("int").alias("salts")),
        "prefix",
    )
    hot = write_out(prefix.where("salts > 1").select("hash", "salts").distinct(), "hot")
    dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    probe = keyed.join(hot.hint("broadcast" if hot.count() <= BROADCAST_ROWS else "shuffle_merge"), "hash", "left")
    probe = probe.withColumn("salt", F.pmod(F.xxhash64("uid", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    start = F.col("pos") - F.col("off")
    met = probe.hint("shuffle_merge").join(dealt, ["hash", "salt"]).where((start >= F.col("run_start")) & (start + F.col("n_words") <= F.col("run_stop")))
    met = met.select("uid", "run_start", F.floor(start / PIECE).cast("int").alias("block"), "item_id", "text", "n_words", start.alias("start"))
    words = runs.select("uid", F.explode("pieces").alias("piece")).select("uid", "piece.run_start", "piece.block", "piece.first", F.split("piece.text", " ").alias("words"))
    # The optimizer may compare before it joins or filters, so a place outside the piece is no error here.
    at = F.col("start") - F.col("first")
    same = F.when((at >= 0) & (at + F.col("n_words") <= F.size("words")), F.array_join(F.slice("words", F.greatest(at, F.lit(0)) + 1, F.col("n_words")), " ") == F.col("text"))
    found = met.hint("shuffle_merge").join(words, ["uid", "run_start", "block"])
    return found.where(F.coalesce(same, F.lit(False))).select("uid", "item_id", "start", F.col("n_words").alias("size"))


def _covered(spans: Column) -> Column:
    """How many words the spans (array of start, stop) cover together."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["stop"] - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["stop"]).alias("upto")
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for every document; contaminated means that some
    word is hit and ``share * n_hit >= n_words``."""
    windows = write_out(benchmark_windows(benchmark, window), "windows")
    bloom, bloom_bits, sizes = _bloom(windows)
    runs = write_out(document_runs(documents, bloom, bloom_bits, sizes, window), "runs")
    hits = (
        occurrences(runs, windows)
        .groupBy("uid")
        .agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("uid", _covered(F.col("spans")).alias("n_hit"), "items")
    )
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return (
        runs.select("uid", "doc_id", "n_words")
        .hint("shuffle_merge")
        .join(hits, "uid", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(items).cast("bigint").alias("n_items"),
            items.alias("items"),
            ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents that ``contamination_report`` does not mark, with all their columns. A doc_id that stands
    on several rows goes if any of them is contaminated."""
    report = contamination_report(documents, benchmark, window, share)
    return keep_without(documents, report.where("contaminated").select("doc_id"))
