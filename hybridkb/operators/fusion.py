"""Fusion of ranked lists, source authority, guaranteed slots, overrides and the refusal gate.

Everything here is keyed by query_id and works on some tens of rows for each query. ``retrieve`` writes out the
lists that several steps read, so the searches run once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.functions.text import is_exact_token_query, rrf_term
from hybridkb.operators.lexical import bm25_search
from hybridkb.operators.vector import knn_search
from hybridkb.sources.staging import size_hint, stage

# Weights and gates of the retrieval policy.
LAYER_WEIGHTS = {"shared": 1.2, "community": 1.0, "vessel": 0.9}
STRONG_BM25 = -5.0
FAR_L2 = 1.0
NO_KNN = 999.0


def below_floor(queries: DataFrame, knn: DataFrame, bm25: DataFrame) -> DataFrame:
    """query_id, refused: nothing found, or no strong lexical hit and only far vectors."""
    d = knn.groupBy("query_id").agg(F.min("distance").alias("d"))
    s = bm25.groupBy("query_id").agg(F.min("score").alias("s"))
    both = queries.select("query_id").join(d, "query_id", "left").join(s, "query_id", "left")
    nothing = F.col("d").isNull() & F.col("s").isNull()
    weak = (F.coalesce("s", F.lit(0.0)) > STRONG_BM25) & (F.coalesce("d", F.lit(NO_KNN)) > FAR_L2)
    return both.select("query_id", (nothing | weak).alias("refused"))


def rrf_fuse(knn: DataFrame, bm25: DataFrame) -> DataFrame:
    """query_id, chunk_id, knn_rank, bm25_rank, score, pos: reciprocal rank fusion; ties keep the vector list's order."""
    a = knn.select("query_id", "chunk_id", F.col("rank").alias("knn_rank"))
    b = bm25.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    term = lambda c: F.coalesce(rrf_term(F.col(c)), F.lit(0.0))
    both = both.withColumn("score", term("knn_rank") + term("bm25_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("knn_rank"), F.asc_nulls_last("bm25_rank"))
    return both.withColumn("pos", F.row_number().over(order))


def layer_authority(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """The fused list weighted by layer and ordered anew; unknown chunks and layers weigh 1."""
    table = F.create_map(*[F.lit(x) for kv in LAYER_WEIGHTS.items() for x in kv])
    layers = fused.join(chunks.select("chunk_id", "layer"), "chunk_id", "left")
    weighted = layers.withColumn("weighted", F.col("score") * F.coalesce(table[F.col("layer")], F.lit(1.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weighted", 12)), "pos")
    return weighted.withColumn("pos", F.row_number().over(order))


def exact_slot(ordered: DataFrame, bm25: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """query_id, chunk_id, pos: the first n, the last place given to the best lexical hit where it is missing
    and the query names an exact token or the hit is strong."""
    top = ordered.where(F.col("pos") <= n).select("query_id", "chunk_id", "pos")
    if n <= 0:
        return top.limit(0)
    best = bm25.where("rank = 1").select("query_id", F.col("chunk_id").alias("best"), F.col("score").alias("s"))
    exact = queries.select("query_id", is_exact_token_query(F.col("text")).alias("exact"))
    force = best.join(exact, "query_id").where(F.col("exact") | (F.col("s") <= STRONG_BM25)).select("query_id", "best")
    force = force.join(top.select("query_id", F.col("chunk_id").alias("best")), ["query_id", "best"], "left_anti")
    sizes = top.groupBy("query_id").agg(F.max("pos").alias("last"))
    force = force.join(sizes, "query_id", "left").select("query_id", F.col("best").alias("chunk_id"), F.when(F.col("last") >= n, n).otherwise(F.coalesce("last", F.lit(0)) + 1).alias("pos"))
    kept = top.join(force.where(F.col("pos") == n).select("query_id", "pos"), ["query_id", "pos"], "left_anti").select("query_id", "chunk_id", "pos")
    return kept.unionByName(force)


def pool_union(ordered: DataFrame, bm25: DataFrame, pool: int = 20) -> DataFrame:
    """query_id, chunk_id, pos: the first ``pool`` fused chunks, then the lexical ones, without repeats."""
    a = ordered.where(F.col("pos") <= pool).select("query_id", "chunk_id", F.col("pos").alias("p"))
    b = bm25.select("query_id", "chunk_id", (F.col("rank") + pool).alias("p"))
    first = a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.min("p").alias("p"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("p")).alias("pos"))


def override_pairs(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, target_id, vessel_id, relation: active vessel chunks of the pool that supersede (the largest
    id wins) or annotate (the smallest) another chunk of the pool; superseding goes first."""
    vessel = chunks.where("layer = 'vessel' AND is_active").select("chunk_id", "supersedes_id", "annotates_id")
    rows = pool.select("query_id", "chunk_id").join(vessel, "chunk_id")
    edges = rows.select("query_id", F.col("chunk_id").alias("vessel_id"), F.col("supersedes_id").alias("target_id"), F.lit("supersede").alias("relation"))
    edges = edges.unionByName(rows.select("query_id", F.col("chunk_id").alias("vessel_id"), F.col("annotates_id").alias("target_id"), F.lit("annotate").alias("relation")))
    targets = pool.select("query_id", F.col("chunk_id").alias("target_id"))
    found = edges.join(targets, ["query_id", "target_id"])
    first = Window.partitionBy("query_id", "target_id").orderBy(
        F.when(F.col("relation") == "supersede", 0).otherwise(1), F.when(F.col("relation") == "supersede", -F.col("vessel_id")).otherwise(F.col("vessel_id"))
    )
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def override_pull_in(top: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """query_id, chunk_id, pos: where the list holds just one side of a pair, the other side comes in. It is appended
    while there is room; a full list gives up its last chunk that no pair names, and grows if there is none.

    A pair that lacks a side at first is looked at once more when its turn comes, as an earlier pair may have brought
    the same chunk. Superseding pairs come first, then by target. Both arrays of a query hold some tens of
    entries, as the list has n and the pool a fixed number of chunks."""
    first = F.when(F.col("relation") == "supersede", 0).otherwise(1).alias("o")
    links = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(first, F.col("target_id").alias("t"), F.col("vessel_id").alias("v")))).alias("links"))
    lists = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    has = lambda x: F.array_contains("ids", x)
    missing = F.transform("links", lambda x: F.when(has(x["t"]) & ~has(x["v"]), x["v"]).when(has(x["v"]) & ~has(x["t"]), x["t"]))
    named = F.flatten(F.transform("links", lambda x: F.array(x["t"], x["v"])))

    def bring(ids: Column, new: Column) -> Column:
        place = F.array_max(F.transform(ids, lambda x, i: F.when(~F.array_contains("named", x), i)))
        swapped = F.transform(ids, lambda x, i: F.when(i == place, new).otherwise(x))
        longer = F.concat(ids, F.array(new))
        return F.when(F.array_contains(ids, new), ids).when((F.size(ids) < n) | place.isNull(), longer).otherwise(swapped)

    both = lists.join(links, "query_id", "left").withColumn("links", F.coalesce("links", F.expr("cast(array() AS array<struct<o:int,t:bigint,v:bigint>>)")))
    worked = both.select("query_id", "ids", F.filter(missing, lambda x: x.isNotNull()).alias("wanted"), named.alias("named"))
    worked = worked.select("query_id", F.posexplode(F.aggregate("wanted", F.col("ids"), bring)).alias("pos", "chunk_id"))
    return worked.select("query_id", "chunk_id", (F.col("pos") + 1).alias("pos"))


def down_rank(working: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """query_id, chunk_id, pos, note: targets whose overrider is in the list go to the end, then the first n."""
    present = working.select("query_id", F.col("chunk_id").alias("vessel_id"))
    active = pairs.hint("shuffle_merge").join(present, ["query_id", "vessel_id"]).select("query_id", F.col("target_id").alias("chunk_id"), "relation")
    noted = working.hint("shuffle_merge").join(active, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("relation").isNotNull(), "pos")
    ranked = noted.withColumn("new_pos", F.row_number().over(order)).where(F.col("new_pos") <= n)
    note = F.when(F.col("relation").isNotNull(), F.concat(F.lit(" [NOTE: "), F.col("relation"), F.lit("d by vessel note]"))).otherwise("")
    return ranked.select("query_id", "chunk_id", F.col("new_pos").alias("pos"), note.alias("note"))


def retrieve(queries: DataFrame, chunks: DataFrame, layers: list[str] | None = None, n: int = 5, pool: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, pos, chunk_id, layer, content, note, refused: the n chunks for each query, best first. A refused
    query has one row, without a chunk. Where the chunks' embeddings are in a table of their own, pass the chunks without them,
    and joined with them as ``vectors``: so texts take no part in that join."""
    knn = stage(knn_search(queries, chunks if vectors is None else vectors, layers, pool), "knn")
    bm25 = stage(bm25_search(queries, chunks, layers, pool), "bm25")
    about = chunks.drop("embedding")
    gate = below_floor(queries, knn, bm25)
    ordered = stage(layer_authority(rrf_fuse(knn, bm25), about), "ordered")
    top = exact_slot(ordered, bm25, queries, n)
    pairs = stage(override_pairs(pool_union(ordered, bm25, pool), about), "pairs")
    gate = stage(gate, "gate")
    final = stage(down_rank(stage(override_pull_in(top, pairs, n), "working"), pairs, n), "final")
    answered = final.hint("shuffle_merge").join(gate.where("NOT refused").drop("refused"), "query_id")
    answered = about.select("chunk_id", "layer", "content").join(answered.hint(size_hint(answered, "note")), "chunk_id")
    refused = gate.where("refused").select("query_id")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("chunk_id", "bigint"), ("layer", "string"), ("content", "string"), ("note", "string"))]
    return answered.select("query_id", "pos", "chunk_id", "layer", "content", "note", F.lit(False).alias("refused")).unionByName(refused.select("query_id", *none, F.lit(True).alias("refused")))
