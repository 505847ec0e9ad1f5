"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. One pass gives every document its set of distinct word shingles, a 128-bit identity of that set and the
   band keys of its SuperMinHash signature (Ertl, 2017). Documents with the same set form one class at once.
2. Classes that share a band key form a bucket. A bucket's hub is its most central class (whose buckets are
   largest); every other member is verified against the hub on the full sets. That is linear in the bucket.
3. What the hub does not settle is settled exactly, without pairs of all members. Let c be the hub, D(x) the
   symmetric difference of x and c, t the threshold of Jaccard similarity J and k = (1 - t) / (1 + t). x and y differ
   where D(x) and D(y) do, so they are linked if |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= k (|x| + |y|). As x is not linked
   to c, |D(x)| > k (|x| + |c|), and so |D(x) & D(y)| > (|D(y)| + k (|c| - |y|)) / 2 >= 0, however far both are from c:
   a prefix of D(y) under any fixed order meets D(x). What stands before the first common token is in one of x and y
   alone, no more than k (|x| + |y|) <= (1 - t) / t |x| tokens, so a prefix of D(x) is enough, too.
   Pairs that meet early enough (by the places of the token in both, and the sizes) are verified on the full sets. In
   D, tokens come in the order of how many members of the bucket have them, so copies that were edited at different
   places do not meet, also where the hub was edited itself, or where all of them lack a part of the hub. (In the sets
   themselves an edit shows by what it adds alone; in D by what it takes away, too.)
   Where the hub leaves more than FEW members unlinked, the nearest of them is a further hub, and so on in rounds, as
   long as a hub links at least a sixteenth of what was left. All links to hubs, of all buckets together, give families
   (components so far): a token that only one family has is dropped before anything meets, and pairs of one family are
   never made, as they are connected already. A second family of any size costs one more comparison for each member.
4. Links become components by contraction.

Band keys find a pair of similarity 0.8 with a chance above 0.9999999 (32 bands of 4 values).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import (
    ASCII_LOWER,
    BROADCAST_ROWS,
    GOLDEN,
    discard,
    list_column,
    mix64,
    field_hash,
    separators,
    shingle_hashes,
    slices_by_bytes,
    field_span,
    spread_join,
    text_buffers,
    tidy,
    word_spans,
    write_out,
)
from hybridkb.llm.components import connected_components

SPACE = separators((0x20, 0x20), (0x09, 0x0D))
CHUNK = 1 << 19
SLOTS, BAND_ROWS = 128, 4
FEW = 16  # unlinked members that are settled without a hub of their own
ELEMENTS = 1 << 16  # shingles whose permutations are held at a time


def document_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; an empty array without words."""
    data, offs = text_buffers(column)
    lower = ASCII_LOWER[data]
    s, e, first = word_spans(lower, offs, SPACE)
    h = field_span(field_hash(lower), s, e)
    whole = shingle_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(shingle_hashes(h[a:b], b - a) ^ np.uint64(b - a) if b > a else h[:0])
    return out


def super_minhash(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots) of sets that lie one after the other in ``elements``; sizes are positive.

    Element v takes the value j + r(v, j) in the slot that its own random permutation has at place j, so the
    slots of one element are correlated and fill evenly. Step j stops for a set as soon as all its slots hold
    less than j.
    """
    n = len(sizes)
    best = np.full(n * slots, float(slots))
    owner = np.repeat(np.arange(n), sizes)
    for at in range(0, len(elements), ELEMENTS):
        v, g = elements[at : at + ELEMENTS], owner[at : at + ELEMENTS]
        perm = None
        for j in range(slots):
            if j:
                worst = best.reshape(n, slots)[g[0] : g[-1] + 1].max(axis=1)
                alive = worst[g - g[0]] > j
                if not alive.any():
                    break
                if not alive.all():
                    v, g = v[alive], g[alive]
                    perm = perm[alive]
            x = mix64(v + np.uint64((j + 1) * int(GOLDEN) % 2**64))
            r = (x >> np.uint64(12)).astype(np.float64) * 2.0**-52
            pick = j + (mix64(x) % np.uint64(slots - j)).astype(np.int64)
            if perm is None:
                slot = pick
                if n * slots and (best.reshape(n, slots)[g[0] : g[-1] + 1].max() > 0):
                    perm = np.empty((len(v), slots), dtype=np.uint8)
                    perm[:] = np.arange(slots, dtype=np.uint8)
                    perm[np.arange(len(v)), pick] = 0
            else:
                rows = np.arange(len(v))
                slot = perm[rows, pick].astype(np.int64)
                perm[rows, pick] = perm[:, j]
            np.minimum.at(best, g * slots + slot, r + j)
    return best.reshape(n, slots)


def _identities(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit identity of each (non-empty) set, independent of order."""
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sizes), 2), dtype=np.uint64)
    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        out[:, i] = mix64(np.add.reduceat(mix64(elements ^ np.uint64(salt)), at) + sizes.astype(np.uint64) * GOLDEN)
    return out


def _binary(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """A binary column of the rows' bytes, null where not present."""
    width = rows.dtype.itemsize * rows.shape[1]
    offs = np.zeros(len(present) + 1, dtype=np.int32)
    np.cumsum(np.where(present, width, 0), out=offs[1:])
    valid = pa.array(present).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(present), [valid, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, sid (identity of the set, null if empty), bands (keys of the signature's bands)."""

    def scan(batches):
        for whole in tidy(batches):
            for at, n in slices_by_bytes(whole.column(1), CHUNK):
                sets = document_sets(whole.column(1).slice(at, n), k)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                full = sizes > 0
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                sid = _identities(flat, sizes[full]) if full.any() else np.zeros((0, 2), np.uint64)
                sig = super_minhash(flat, sizes[full])
                rows = sig.view(np.uint64).reshape(len(sig), SLOTS // BAND_ROWS, BAND_ROWS)
                keys = np.broadcast_to(np.arange(SLOTS // BAND_ROWS, dtype=np.uint64) * GOLDEN, rows.shape[:2])
                for i in range(BAND_ROWS):
                    keys = mix64(keys + rows[:, :, i])
                bands = list_column(keys.reshape(-1).view(np.int64), np.where(full, SLOTS // BAND_ROWS, 0), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(at, n), pa.array(sizes), _binary(sid, full), bands], names=["doc_id", "n_shingles", "sid", "bands"]
                )

    schema = "doc_id bigint, n_shingles bigint, sid binary, bands array<bigint>"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def _sets_of(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """sid, elements (the sorted set's bytes) of the wanted (doc_id, sid), one document each."""
    n = wanted.count()
    ids = wanted.select(F.col("doc_id").alias("_wanted"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.join(ids.hint("broadcast" if n <= BROADCAST_ROWS else "shuffle_merge"), docs["doc_id"].eqNullSafe(ids["_wanted"]), "left_semi")

    def scan(batches):
        for whole in tidy(batches):
            for at, count in slices_by_bytes(whole.column(1), CHUNK):
                sets = [x for x in document_sets(whole.column(1).slice(at, count), k) if len(x)]
                if not sets:
                    continue
                sizes = np.array([len(x) for x in sets])
                sid = _identities(np.concatenate(sets), sizes)
                yield pa.RecordBatch.from_arrays(
                    [_binary(sid, np.ones(len(sets), bool)), pa.array([x.tobytes() for x in sets], type=pa.binary())], names=["sid", "elements"]
                )

    found = docs.mapInArrow(scan, "sid binary, elements binary")
    return found.hint("shuffle_merge").join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, settle: bool) -> DataFrame:
    """c, x, linked for pairs of set identities; with ``settle``, also the sizes and differences (D) of step 3."""
    left = sets.select(F.col("sid").alias("x"), F.col("elements").alias("ex"))
    right = sets.select(F.col("sid").alias("c"), F.col("elements").alias("ec"))
    # A hub's set goes once to each thousand of its members.
    counts = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    right = write_out(right.hint("shuffle_merge").join(counts, "c"), "hub-sets")
    both = spread_join(pairs.hint("shuffle_merge").join(left, "x"), right, ["c"], ["x"]).select("c", "x", "ec", "ex")
    schema = "c binary, x binary, linked boolean" + ", hub_size bigint, size bigint, differ bigint, tokens array<bigint>" * settle
    t, none = percent, np.zeros(0, np.int64)

    def verify(batches):
        for batch in tidy(batches):
            linked, sizes, tokens = [], [], [none]
            for ec, ex in zip(batch.column(2), batch.column(3), strict=True):
                c, x = np.frombuffer(ec.as_buffer(), np.uint64), np.frombuffer(ex.as_buffer(), np.uint64)
                inter = len(np.intersect1d(c, x, assume_unique=True))
                linked.append(100 * inter >= t * (len(c) + len(x) - inter))
                if settle:
                    sizes.append((len(c), len(x), len(c) + len(x) - 2 * inter))
                    tokens.append(np.setxor1d(x, c, assume_unique=True).view(np.int64))
            cols = [batch.column(0), batch.column(1), pa.array(linked, type=pa.bool_())]
            if settle:
                cols += [pa.array([v[i] for v in sizes], type=pa.int64()) for i in range(3)]
                cols.append(list_column(np.concatenate(tokens), np.array([len(x) for x in tokens[1:]], dtype=np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["c", "x", "linked"] + ["hub_size", "size", "differ", "tokens"] * settle)

    return both.mapInArrow(verify, schema)


def near_duplicate_links(documents: DataFrame, signed: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between identities of sets whose Jaccard similarity is at least ``percent`` / 100; all
    components are connected by them, though not every linked pair is named."""
    classes = signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    members = classes.select("sid", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = write_out(spread_join(members, write_out(shared.withColumn("n", F.col("size")), "shared"), ["key"], ["sid"]), "members")
    scores = members.groupBy("sid").agg(F.sum("size").alias("score"))
    scored = members.hint("shuffle_merge").join(scores, "sid")
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", "sid")).alias("best"), F.count(F.lit(1)).alias("n")).select("key", F.col("best.sid").alias("c"), "n")
    pairs = spread_join(members, write_out(hubs, "hubs"), ["key"], ["sid"]).where("sid <> c").select("c", F.col("sid").alias("x")).distinct()
    pairs = write_out(pairs, "pairs")
    involved = pairs.select(F.col("x").alias("sid")).union(pairs.select("c")).distinct()
    wanted = write_out(signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).hint("shuffle_merge").join(involved, "sid"), "wanted")
    sets = write_out(_sets_of(documents, wanted, k), "sets")
    star = write_out(_compare(pairs, sets, percent, settle=True), "star")
    judged = _families(star, sets, percent)
    linked = [_linked(t) for t in [star, *judged]]
    roots = write_out(connected_components(reduce(DataFrame.unionByName, linked)), "roots")
    rest = _meetings(star, roots, percent).hint("shuffle_merge").join(pairs, ["c", "x"], "left_anti")
    rest = write_out(rest, "rest")
    found = _linked(_compare(rest, sets, percent, settle=False))
    links = write_out(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), "found")
    discard(members, wanted, sets, rest, star, pairs, roots, *judged)
    return links


def _linked(compared: DataFrame) -> DataFrame:
    """a, b of the compared pairs that are linked."""
    return compared.where("linked").select(F.col("c").alias("a"), F.col("x").alias("b"))


def _families(star: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of comparisons (c, x, linked) of members that their bucket's hub leaves unlinked with further hubs."""
    open_ = star.where("NOT linked").select("c", "x", "differ")
    judged = []
    while True:
        hubs = open_.groupBy("c").agg(F.min(F.struct("differ", "x")).alias("best"), F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW)
        hubs = write_out(hubs.select("c", F.col("best.x").alias("hub"), "n"), "hubs")
        if hubs.isEmpty():
            return judged
        asked = write_out(spread_join(open_, hubs, ["c"], ["x"]), "asked")
        compared = _compare(asked.where("x <> hub").select(F.col("hub").alias("c"), "x").distinct(), sets, percent, settle=False)
        judged.append(write_out(compared, "judged"))
        yes = judged[-1].where("linked").select(F.col("c").alias("hub"), "x", F.lit(True).alias("found"))
        met = write_out(asked.hint("shuffle_merge").join(yes, ["hub", "x"], "left").withColumn("found", F.coalesce("found", F.col("x") == F.col("hub"))), "met")
        # A hub that links next to nothing ends its bucket's rounds: it is no family, and its rows share few tokens.
        share = met.groupBy("c").agg(F.count_if("found").alias("m"), F.count(F.lit(1)).alias("n")).where("16 * m >= n").select("c", "n")
        open_ = spread_join(met.where("NOT found").select("c", "x", "differ"), write_out(share, "share"), ["c"], ["x"])
        open_ = write_out(open_, "open")


def _meetings(star: DataFrame, roots: DataFrame, p: int) -> DataFrame:
    """c, x: pairs of members of one hub and of different families (components so far) that may be linked, although one
    of them is not linked to the hub: those that share a token early enough in their differences from the hub. Tokens
    are ordered by how many members have them, those of a single family first, which meet nobody and only count. So what
    all members differ in stands last, and copies that were edited at different places do not meet."""
    known = star.hint("shuffle_merge").join(roots.withColumnRenamed("node", "x"), "x", "left")
    known = write_out(known.withColumn("family", F.coalesce("root", "x")).drop("root"), "known")
    about = ["c", "x", "hub_size", "size", "differ", "linked", "family"]
    full = known.select(*about, F.explode("tokens").alias("token"))
    shared = full.groupBy("c", "token").agg(F.min("family").alias("least"), F.max("family").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    shared = write_out(shared.select("c", "token", "n"), "tokens")
    rows = spread_join(full, shared.withColumn("often", F.col("n")), ["c", "token"], ["x"])
    lists = rows.groupBy(*about).agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    placed = lists.select(*about, (F.col("differ") - F.size("tokens")).alias("first"), F.posexplode("tokens").alias("at", "t"))
    placed = placed.select(*about, (F.col("first") + F.col("at")).alias("i"), F.col("t.token").alias("token")).where(f"{p} * i <= {100 - p} * size")
    placed = write_out(placed, "placed")
    need = f"({100 + p} * differ + {100 - p} * (hub_size - size)) div {2 * (100 + p)}"
    member = F.struct("x", "size", "differ", "family")
    probe = placed.where("NOT linked").select("c", "token", member.alias("a"), "i")
    index = placed.where(f"i < differ - {need}").select("c", "token", member.alias("b"), F.col("i").alias("j"))
    # If a token is the first that two members share, no more than what is left behind it can be common; a link needs so much.
    able = f"2 * {100 + p} * least(a.differ - i, b.differ - j) >= {100 + p} * (a.differ + b.differ) - {100 - p} * (a.size + b.size)"
    met = probe.hint("shuffle_merge").join(index, ["c", "token"]).where(f"a.family <> b.family AND a.x <> b.x AND {able}")
    return met.select(F.least("a.x", "b.x").alias("c"), F.greatest("a.x", "b.x").alias("x")).distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    k: words in a shingle; percent: the least Jaccard similarity of a link. component_id is the smallest
    doc_id of the group, kept marks the document that has it. Words are runs of anything but ASCII white
    space, with A-Z lower-cased; fewer than k words are one shingle. A text without words, or null, has an
    empty set and is linked with nothing. Rows that repeat a doc_id are reported once each; a null doc_id is
    never the smallest unless all are null. Empty tables give empty results, other columns are ignored.
    """
    signed = write_out(signatures(documents, k), "signed")
    links = near_duplicate_links(documents, signed, k, percent)
    roots = connected_components(links)
    rows = signed.select("doc_id", "n_shingles", "sid")
    # A set may be that of a third of all rows, and so may the missing one be.
    counts = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    named = write_out(roots.withColumnRenamed("node", "sid").hint("shuffle_merge").join(counts, "sid"), "named")
    rooted = spread_join(rows.where("sid IS NOT NULL"), named, ["sid"], ["doc_id"], "left").select("doc_id", "n_shingles", F.coalesce("root", "sid").alias("root"))
    rooted = write_out(rooted.unionByName(rows.where("sid IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("binary").alias("root"))), "rooted")
    discard(signed)
    rooted_ = rooted.where("root IS NOT NULL")
    least = rooted_.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A group may hold a third of all rows.
    groups = spread_join(rooted_, write_out(least, "least"), ["root"], ["doc_id"], "left")
    groups = groups.select("doc_id", "n_shingles", "least").unionByName(rooted.where("root IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("least")))
    component = F.coalesce("least", "doc_id")
    return groups.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; null ids stay."""
    from hybridkb.llm.verdicts import keep_without

    groups = near_duplicates(documents, k, percent)
    return keep_without(documents, groups.where("NOT kept AND doc_id IS NOT NULL").select("doc_id"))
