"""Shared helpers: tables written to the shared folder, and numpy kernels over Arrow text columns."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridkb.sources.staging import shared_dir

def write_out(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a reread of files that are still there, and everything computed from
    row ids or random samples sees the same rows each time. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/hybridkb-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._written_path = path  # type: ignore[attr-defined]
    return out


def fresh_name(names: list[str], stem: str) -> str:
    """A column name that none of ``names`` equals, whatever their case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def discard(*tables: DataFrame) -> None:
    """Delete tables that write_out made and that no later plan reads."""
    for t in tables:
        delete_folder(t.sparkSession, getattr(t, "_written_path", None))


def delete_folder(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of the shared file system, if one is given."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


HOT = 1000  # rows of one key that go to one task in spread_join
BROADCAST_ROWS = 250_000  # ids of 8 bytes: some 4 MB in memory at most


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner", size: str = "n") -> DataFrame:
    """``rows`` joined on the columns ``on`` with a written ``table`` that has one row for each key and, as
    ``size``, the number of rows that share it. Keys of more than HOT rows are dealt over salts, by the columns
    ``by``, and only their rows of the table are copied: no more than one for each HOT rows."""
    salts = F.ceil(F.col(size) / HOT).cast("int")
    hot = table.where(F.col(size) > HOT).select(*on, salts.alias("salts"))
    n = hot.count()
    if not n:
        return rows.hint("shuffle_merge").join(table.drop(size), on, how)
    dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(size)
    marked = rows.join(hot.hint("broadcast" if n <= BROADCAST_ROWS else "shuffle_merge"), on, "left")
    marked = marked.withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return marked.hint("shuffle_merge").join(dealt, [*on, "salt"], how).drop("salt")


# --- numpy kernels -------------------------------------------------------------------------------

MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x9E3779B185EBCA87)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def give_back() -> None:
    """Return freed memory to the system: a worker keeps it otherwise, beside what the next operator needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps between tasks of one operator; the next operator's tasks, which may run in the same worker, drop it.
WORKER_CACHES: list[dict] = []


def tidy(batches):
    """The batches, with freed memory given back before each and behind the last."""
    for cache in WORKER_CACHES:
        cache.clear()
    give_back()
    for batch in batches:
        yield batch
        del batch
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, for i < n."""
    if not _powers or len(_powers[0]) < n:
        room = max(n, 1 << 16)
        up, down = np.full(room, BASE), np.full(room, BASE_INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with len(data) + 1 entries; (h[e] - h[s]) * BASE ** -s is a hash of data[s:e]: a cheap one to find candidates
    by, which some pairs of strings share whatever the base. Identities are field_span's."""
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    codes = BYTE_CODES[data]
    codes *= powers(len(data))[0]
    np.cumsum(codes, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of starts and ends."""
    down = powers(len(h))[1]
    return mix64((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


# --- identities of substrings ---------------------------------------------------------------------

#: Two polynomial hashes modulo the prime 2 ** 31 - 1. Modulo a power of two, as above, some strings collide for every
#: base (Thue-Morse words of 1,024 letters); modulo a prime, two strings of n bytes do for n of its bases at most.
PRIME = np.uint64(2**31 - 1)
HALF = np.uint64(31)
FIELD_BASES = tuple(int(x) % (2**31 - 3) + 2 for x in mix64(np.arange(1001, 1003, dtype=np.uint64) * GOLDEN))
FIELD_CODES = mix64(np.arange(2001, 2513, dtype=np.uint64) * GOLDEN).reshape(2, 256) % PRIME

_field_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, but for at most 2 ** 33 / PRIME times it."""
    return (x & PRIME) + (x >> HALF)


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, from 0 to PRIME - 1."""
    x = _fold(_fold(x))
    return np.where(x >= PRIME, x - PRIME, x)


def field_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases the powers with exponents below n, and their inverses, modulo PRIME."""
    if not _field_powers or len(_field_powers[0][0]) < n:
        room = 1 << max(16, (n - 1).bit_length())

        def row(base: int) -> np.ndarray:
            out = np.ones(room, dtype=np.uint32)
            have = 1
            while have < room:
                step = np.uint64(pow(base, have, int(PRIME)))
                out[have : 2 * have] = _residue(out[:have].astype(np.uint64) * step)
                have *= 2
            return out

        _field_powers[:] = [(row(b), row(pow(b, -1, int(PRIME)))) for b in FIELD_BASES]
    return _field_powers


def field_hash(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of ``data`` for field_span: len(data) + 1 pairs of 31 bits, one in each half of a word."""
    n = len(data)
    out = np.zeros(n + 1, dtype=np.uint64)
    for k, (up, _) in enumerate(field_powers(n + 1)):
        x = FIELD_CODES[k][data]
        x *= up[:n]
        x = _fold(x)
        np.cumsum(x, out=x)
        out[1:] |= _residue(x) << np.uint64(32 * k)
        del x
    return out


def field_span(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit identities of data[start:end], from 62 bits of hash and the length."""
    parts = []
    for k, (_, down) in enumerate(field_powers(len(h))):
        half = lambda at: (h[at] >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)  # noqa: B023, E731
        parts.append(_residue(_fold(half(end) + PRIME - half(start)) * down[start]))
    return mix64((parts[0] | parts[1] << HALF) + (end - start).astype(np.uint64) * GOLDEN)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices_by_bytes(column: pa.Array, limit: int):
    """(first row, number of rows) of runs of rows whose texts hold about ``limit`` bytes, one row at least."""
    _, offs = text_buffers(column)
    start, n = 0, len(column)
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end - start
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``separator`` (a table of 256 booleans), never across
    a text's end, and for each text the index of its first word (one entry more than texts)."""
    if len(data) == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a text begins or ends here
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes in the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; entry i begins at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = words[:n].copy()
    for j in range(1, k):
        x = mix64(x + GOLDEN) * BASE + words[j : j + n]
    return mix64(x)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of the flat values, cut by lengths."""
    offs = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))
