"""Spelling variants: words one edit apart from a far more frequent word, found by a bit-sliced position index.

The index of a block of words has a bitset over the block for each (position, letter). A query runs through its
letters once and keeps three sets of words as bits: those that agree so far, those with one letter replaced so far,
and those with one letter more so far, whose bits are read one position further on. A step is a handful of
operations on whole machine words, for all queries of a block at the same time. Queries look for words of their own
length and of one letter more; the other direction is the same pair.

Blocks are made so that no near pair is lost and no word meets the whole vocabulary. Of two words one edit apart, of
m letters and m or m + 1, the first m // 2 letters are equal, or the last m // 2 are. So a word goes to four buckets:
by both halves, as one of m letters and as one of m + 1. A pair in both buckets counts in that of the first half
alone. A bucket of more than ``bucket_words`` words is split by the same rule on the letters that are not yet known
to be equal, as often as needed; where a single letter is left it holds no more words than an alphabet squared.

Words are counted before anything else is shuffled. What travels between stages is written out; forms are followed
to their roots level by level, on joins by form, which no more words share than there are edits of a word.

Defined results: null texts have no words; a null doc_id stands for itself as empty text in the hash that decides
which letter is dropped. Repeated rows count as often as they stand there. Ties for the form go to the smallest
word in code-point order. Words of any length are compared in full. An empty table, or one without words frequent
enough, gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import BROADCAST_ROWS, write_out

RUN = "[A-Za-zÀ-ÿ]+"
DROP_EVERY = 199
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
BUCKET_WORDS = 4096
BLOCK_WORDS = 1024
BLOCK_LETTERS = 1 << 22
#: Up to this length words of several lengths may share a block.
SHORT = 32
NO_GUARD = 2**31 - 1


def runs(documents: DataFrame) -> DataFrame:
    """doc_id as text, run: the maximal runs of letters of every text, A to Z in lower case."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    # Runs of ASCII alone, nearly all, are spared the slower mapping by character.
    plain = F.octet_length("run") == F.length("run")
    lowered = F.when(plain, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return rows.select("doc_id", lowered.alias("run"))


def word_counts(documents: DataFrame, drop_every: int = DROP_EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    marked = runs(documents).where(F.length("run") >= least_letters).withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = marked.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _bucket(rows: DataFrame) -> DataFrame:
    """The rows with the number of their bucket: what is known to be equal of words of m letters and m + 1."""
    known = [F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b"))]
    return rows.withColumn("bucket", F.xxhash64("m", "a", "b", "guard", *known))


def _half(m: Column, a: Column, b: Column, guard: Column) -> Column:
    """The two ways to know half of the letters that are open so far, first or last half. ``guard`` is the length
    of a common prefix from which on a pair belongs to another bucket."""
    half = F.floor((m - a - b) / 2).cast("int")
    first = F.struct(m.alias("m"), (a + half).alias("a"), b.alias("b"), guard.alias("guard"))
    last = F.struct(m.alias("m"), a.alias("a"), (b + half).alias("b"), F.least(guard, a + half).alias("guard"))
    return F.filter(F.array(first, last), lambda x: x["a"] < x["guard"])


def buckets(words: DataFrame, least_letters: int = LEAST_LETTERS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """word, n, m, a, b, guard, bucket: every bucket that a word belongs to, large ones split."""
    zero = F.lit(0)
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= least_letters)
    places = F.flatten(F.transform(lengths, lambda m: _half(m, zero, zero, F.lit(NO_GUARD))))
    rows = write_out(_bucket(words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")), "spelling-buckets")
    done = []
    while True:
        large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("m") - F.col("a") - F.col("b")).alias("open"))
        large = write_out(large.where((F.col("size") > bucket_words) & (F.col("open") > 1)).select("bucket"), "spelling-large")
        n = large.count()
        if not n:
            done.append(rows)
            break
        hint = "broadcast" if n <= BROADCAST_ROWS else "shuffle_merge"
        done.append(rows.join(large.hint(hint), "bucket", "left_anti"))
        split = rows.join(large.hint(hint), "bucket", "left_semi")
        split = split.select("word", "n", F.explode(_half(F.col("m"), F.col("a"), F.col("b"), F.col("guard"))).alias("p")).select("word", "n", "p.*")
        rows = write_out(_bucket(split), "spelling-buckets")
    columns = ["word", "n", "m", "a", "b", "guard", "bucket"]
    out = done[0].select(columns)
    for more in done[1:]:
        out = out.unionByName(more.select(columns))
    return out


# --- the index of a block ------------------------------------------------------------------------


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(a row of letter numbers for each word, 0 behind its end; lengths; how many different letters)."""
    texts = words.to_pylist()
    size = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    known, numbers = np.unique(codes, return_inverse=True)
    table = np.zeros((len(texts), int(size.max(initial=0)) + 2), dtype=np.int32)
    table[np.arange(table.shape[1])[None, :] < size[:, None]] = numbers + 1
    return table, size, len(known)


def bitset(member: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((*member.shape[:-1], -(-member.shape[-1] // 64) * 64), dtype=bool)
    wide[..., : member.shape[-1]] = member
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def near_pairs(words: pa.Array, m: np.ndarray, a: np.ndarray, guard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all words i of m[i] letters and words j one edit away of as many letters (i < j) or one more, whose
    common prefix has at least a[i] letters and fewer than guard[i]."""
    table, size, n_letters = letters(words)
    asked = np.flatnonzero(size == m)
    if not len(asked) or len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = ~np.uint64(0)
    alphabet = np.arange(1, n_letters + 1)

    def slices(p: int) -> np.ndarray:
        """A bitset for each letter at a position; entry 0, for queries that have ended, is full."""
        out = np.empty((n_letters + 1, -(-len(words) // 64)), dtype=np.uint64)
        out[0] = full
        out[1:] = bitset(table[:, p][None, :] == alphabet[:, None])
        return out

    of_length = {k: bitset(size == k) for k in {*m[asked].tolist(), *(m[asked] + 1).tolist()}}
    width = -(-len(words) // 64)
    found = []
    room = max(1, (1 << 17) // width)
    for lo in range(0, len(asked), room):
        q = asked[lo : lo + room]
        equal = np.full((len(q), width), full)
        replaced, longer = np.zeros_like(equal), np.zeros_like(equal)
        prefix, beyond = equal.copy(), np.zeros_like(equal)
        here = slices(0)
        for p in range(int(size[q].max())):
            there = slices(p + 1)
            match, match_next = here[table[q, p]], there[table[q, p]]
            longer = (longer | equal) & match_next
            replaced = (replaced & match) | (equal & ~match)
            equal = equal & match
            for at, kept in ((a, prefix), (guard, beyond)):
                now = np.flatnonzero(at[q] == p + 1)
                kept[now] = equal[now]
            here = there
        same = np.stack([of_length[k] for k in m[q].tolist()])
        more = np.stack([of_length[k + 1] for k in m[q].tolist()])
        near = ((replaced & same) | ((longer | equal) & more)) & prefix & ~beyond
        i, w = np.nonzero(near)
        bit = np.unpackbits(near[i, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, offset = np.nonzero(bit)
        i, j = q[i[k]], w[k] * 64 + offset
        kept = (size[j] > size[i]) | (i < j)
        found.append((i[kept], j[kept]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets, of BLOCK_WORDS rows or so; buckets come one behind the other."""
    rest: list[pa.Table] = []
    for batch in batches:
        table = pa.concat_tables([*rest, pa.Table.from_batches([batch])]).combine_chunks()
        m, bucket = table.column("m").to_numpy(), table.column("bucket").to_numpy()
        starts = np.append(0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (m[1:] != m[:-1])) + 1)
        lo = 0
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            # The bucket from s to e is whole; what is open before it leaves if both are too many or too long.
            if s > lo and (e - lo > BLOCK_WORDS or (e - lo) * int(m[s]) > BLOCK_LETTERS or (m[s] != m[lo] and m[s] > SHORT)):
                yield table.slice(lo, s - lo)
                lo = s
        last = int(starts[-1])
        if last > lo:
            yield table.slice(lo, last - lo)
        rest = [table.slice(last)]
    if rest and rest[0].num_rows:
        yield rest[0]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        block = block.combine_chunks()
        word, n = block.column("word").chunk(0), block.column("n").to_numpy()
        key = [block.column(c).to_numpy() for c in ("m", "a", "b", "guard", "bucket")]
        i, j = near_pairs(word, key[0], key[1], key[3])
        together = np.logical_and.reduce([k[i] == k[j] for k in key])
        i, j = i[together], j[together]
        if len(i):
            both = (np.concatenate([i, j]), np.concatenate([j, i]))
            yield pa.RecordBatch.from_arrays([word.take(pa.array(both[0])), pa.array(n[both[0]]), word.take(pa.array(both[1])), pa.array(n[both[1]])], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """word, n, near, near_n: every two words one edit apart, once in each direction."""
    rows = buckets(words, least_letters, bucket_words)
    dealt = rows.repartition("bucket").sortWithinPartitions("m", "bucket", "word")
    return dealt.mapInArrow(_near, "word string, n bigint, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form, for written (word, form) rows without cycles."""
    level = forms.select(F.col("form").alias("word")).distinct().join(forms.hint("shuffle_merge").select("word"), "word", "left_anti")
    level = level.select("word", F.col("word").alias("root"))
    done = None
    while True:
        parents = level.select(F.col("word").alias("form"), "root").hint("shuffle_merge")
        level = write_out(forms.join(parents, "form").select("word", "root"), "spelling-roots")
        done = level if done is None else done.unionByName(level)
        if level.isEmpty():
            return done


def spelling_forms(documents: DataFrame, factor: int = FACTOR, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word that is long and frequent enough."""
    words = write_out(word_counts(documents), "spelling-words")
    pairs = near_words(words, bucket_words=bucket_words)
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rank"), "near")))
    judged = pairs.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    far = -F.col("best.rank") >= factor * F.col("n")
    judged = write_out(judged.select("word", F.when(far, F.col("best.near")).alias("form"), "n", "n_near", F.when(far, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    found = roots(judged.where("form IS NOT NULL").select("word", "form"))
    out = judged.join(found.hint("shuffle_merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
