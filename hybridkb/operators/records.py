"""Records: inventory, locations, deviations, maintenance entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.functions.text import slugify, text_contains_any, yaml_quote
from hybridkb.operators.numbering import number_rows, with_previous
from hybridkb.sources.staging import size_hint, stage

# Systems in the order in which a partial match is decided.
SYSTEMS = ("engine", "electrical", "plumbing", "rigging", "sails", "hull/deck", "electronics/nav", "ground tackle", "safety", "refrigeration", "other")
# Categories, and the words that stand for them.
CATEGORIES = ("spare", "provision", "tool", "toy", "safety")
SYNONYMS = {
    "food": "provision",
    "provisions": "provision",
    "drink": "provision",
    "water": "provision",
    "galley": "provision",
    "consumable": "provision",
    "consumables": "provision",
    "flare": "safety",
    "flares": "safety",
    "lifejacket": "safety",
    "life jacket": "safety",
    "pfd": "safety",
    "epirb": "safety",
    "first aid": "safety",
    "first aid kit": "safety",
    "fire extinguisher": "safety",
    "liferaft": "safety",
    "life raft": "safety",
    "harness": "safety",
    "man overboard": "safety",
    "tool": "tool",
    "tools": "tool",
    "toolbox": "tool",
    "hand tool": "tool",
    "power tool": "tool",
    "toy": "toy",
    "toys": "toy",
    "game": "toy",
    "games": "toy",
}


def normalise_system(raw: Column) -> Column:
    """A system name: exact, else the first system of which a word (or slash part) stands in the text, else other."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    found = F.split(F.regexp_replace(t, r"[^a-z0-9/ ]", " "), r"\s+")
    out = F.when(t.isin(*SYSTEMS), t)
    for s in SYSTEMS:
        out = out.when(F.arrays_overlap(found, F.array(*[F.lit(x) for x in s.split("/")])), s)
    return out.otherwise("other")


def normalise_category(raw: Column) -> Column:
    """An exact category or synonym, else spare."""
    known = SYNONYMS | {c: c for c in CATEGORIES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(table[F.lower(F.trim(raw))], F.lit("spare"))


def normalise_enum(raw: Column, values: list[str]) -> Column:
    """The value in lower case if it is one of them, else NULL."""
    t = F.lower(F.trim(raw))
    return F.when(t.isin(*values), t)


GRAM = 3  # characters of the pieces by which questions are looked up
DEALT = 2000  # rows of one piece that go to one task


def pieces(fields: list[Column], sizes: list[int]) -> Column:
    """The different pieces of the fields, of the given lengths, in lower case; of length 0 the empty one."""
    lower = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in fields])

    def cut(size: int) -> Column:
        if size == 0:
            return F.array(F.lit(""))
        long_enough = F.filter(lower, lambda x: F.length(x) >= size)
        return F.flatten(F.transform(long_enough, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, F.lit(size)))))

    return F.array_distinct(F.concat(*[cut(n) for n in sizes]))


def find_items(items: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """query_id with the items that hold its text in any column, as they stand.

    A question is looked up by the rarest of its pieces of three characters among the items, and then compared whole;
    one of which some piece occurs nowhere meets no item. Questions of fewer characters are their own piece; the empty
    one meets every item, a NULL one none. A piece that many items hold is dealt over many tasks."""
    asked = queries.where("text IS NOT NULL").select("query_id", F.lower("text").alias("q"))
    grams = F.when(F.length("q") < GRAM, F.array("q")).otherwise(pieces([F.col("q")], [GRAM]))
    asked = stage(asked.withColumn("grams", grams), "questions")
    sizes = [r[0] for r in asked.select(F.length(F.get("grams", F.lit(0)))).distinct().collect()]  # GRAM + 1 numbers at most
    if not sizes:
        return items.limit(0).withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType))
    fields = [F.col(c) for c in columns]
    wanted = asked.select("query_id", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    known = stage(wanted.select("gram").distinct(), "pieces")
    counts = items.select(F.explode(pieces(fields, sizes)).alias("gram")).join(known.hint(size_hint(known, "gram")), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = wanted.hint("shuffle_merge").join(counts, "gram").groupBy("query_id", "n_grams").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "gram")).alias("best"))
    picks = best.where("found = n_grams").select("query_id", "best.*")
    picks = stage(picks.hint("shuffle_merge").join(asked.select("query_id", "q"), "query_id"), "picks")
    cut = items.withColumn("gram", F.explode(pieces(fields, sizes)))
    hint = size_hint(picks, "q", "gram")
    if hint == "broadcast":
        met = cut.join(picks.drop("n").hint(hint), "gram")
    else:
        salts = F.ceil(F.col("n") / DEALT).cast("int")
        salted = picks.select("gram", salts.alias("salts")).distinct()
        rows = cut.hint("shuffle_merge").join(salted, "gram").withColumn("salt", F.pmod(F.xxhash64(*items.columns), F.col("salts")).cast("int")).drop("salts")
        met = rows.hint("shuffle_merge").join(picks.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), ["gram", "salt"]).drop("salt")
    return met.where(text_contains_any(F.col("q"), *fields)).drop("gram", "q")


def item_descriptor(name: Column, category: Column, aliases: Column, label: Column, slot: Column, brand: Column, model: Column, extra: Column, notes: Column) -> Column:
    """The text by which an item is found."""
    given = lambda c, head: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    kind = F.concat(F.lit("("), F.concat_ws(", ", category, F.when(F.coalesce(aliases, F.lit("")) != "", aliases)), F.lit(")"))
    place = F.when(label.isNull(), "— location unknown").otherwise(F.concat(F.lit("— "), F.concat_ws(", ", label, F.when(F.coalesce(slot, F.lit("")) != "", slot))))
    return F.concat_ws(" ", F.concat(F.lit("[Item] "), name), kind, place, given(brand, "Brand: "), given(model, "Model: "), given(extra, ""), given(notes, ""), given(aliases, "Aliases: "))


def deviation_descriptor(component: Column, factory: Column, built: Column, reason: Column, noted: Column, label: Column, notes: Column) -> Column:
    given = lambda c, head: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    place = F.concat(F.lit("— "), F.coalesce(label, F.lit("location unknown")))
    return F.concat_ws(" ", F.concat(F.lit("[Deviation] "), component), given(factory, "factory: "), given(built, "as-built: "), given(reason, "reason: "), given(noted, "noted: "), place, given(notes, ""))


def location_moves(moves: DataFrame, item: str, place: str, ts: str) -> DataFrame:
    """The rows that move an item: its first, and those whose place differs from the one before (null is a place)."""
    rows = with_previous(moves.select(item, place, ts), [item], [ts], "_before")
    return rows.where(F.col("_before").isNull() | ~F.col(f"_before.{place}").eqNullSafe(F.col(place))).drop("_before")


def latest_moves(moves: DataFrame, item: str, place: str, ts: str, n: int = 3) -> DataFrame:
    """item, current, n_moves (the first row is none), latest (the ``n`` places before the current, newest first)."""
    real = stage(location_moves(moves, item, place, ts), "moves")
    counts = real.groupBy(item).agg((F.count(F.lit(1)) - 1).cast("int").alias("n_moves"))
    # Only the newest rows of an item leave their partition.
    nth = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(ts)))
    newest = real.withColumn("_nth", nth).where(F.col("_nth") <= n + 1)
    lists = newest.groupBy(F.col(item).alias("_item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.col(place).alias("place")))), lambda x: x["place"]).alias("places"))
    joined = counts.join(lists.hint("shuffle_merge"), F.col(item).eqNullSafe(F.col("_item")))
    return joined.select(item, F.get("places", F.lit(0)).alias("current"), "n_moves", F.slice("places", 2, n).alias("latest"))


def resolve_zone(rows: DataFrame, zones: DataFrame, name: str) -> DataFrame:
    """zone_id and a warning: unknown, blank and ambiguous names give NULL."""
    known = zones.groupBy(F.col("name").alias("_name")).agg(F.min("zone_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(known, rows[name] == known["_name"], "left")
    warning = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "blank").when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous")
    return joined.withColumn("zone_id", F.when(F.col("_n") == 1, F.col("_id"))).withColumn("warning", warning).drop("_name", "_id", "_n")


def slot_valid(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """reason: NULL where the slot is absent or in its zone's grid, else why not."""
    grids = slots.groupBy("zone_id").agg(F.count(F.lit(1)).alias("_n"))
    cells = slots.select("zone_id", "row", "col", F.lit(True).alias("_cell")).distinct()
    joined = rows.hint("shuffle_merge").join(grids, "zone_id", "left").hint("shuffle_merge").join(cells, ["zone_id", "row", "col"], "left")
    reason = F.when(F.col("row").isNull(), None).when(F.col("_n").isNull(), "zone has no grid").when(F.col("_cell").isNull(), "outside the grid")
    return joined.withColumn("reason", reason).drop("_n", "_cell")


def grid_counts(slots: DataFrame) -> DataFrame:
    """zone_id, n_slots, n_rows, n_cols of every zone that has a grid of slots (zone_id, row, col)."""
    return slots.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_slots"), F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))


def sub_slot_grid(zones: DataFrame, rows: Column, cols: Column, labels: Column) -> DataFrame:
    """zone_id, row, col, row_label: the slots of zones with ``rows`` by ``cols`` of them, from 1; rows beyond the labels
    have none, and zones without rows or columns no slots."""
    size = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))
    by_row = zones.select("zone_id", F.explode(size(rows)).alias("row"), labels.alias("_labels"), cols.alias("_cols"))
    return by_row.select("zone_id", "row", F.explode(size(F.col("_cols"))).alias("col"), F.get("_labels", F.col("row") - 1).alias("row_label"))


def annotation_progress(zones: DataFrame) -> DataFrame:
    """zone_id, name, annotated, place, n_annotated, n_zones: zones with neither image nor geometry missing are annotated;
    the others come first, then by name. ``place`` is the row's, from 0, and the counts are of all zones."""
    done = F.col("schematic_image").isNotNull() & F.col("geometry").isNotNull()
    rows = zones.select("zone_id", "name", done.alias("annotated"))
    totals = rows.agg(F.count_if("annotated").alias("n_annotated"), F.count(F.lit(1)).alias("n_zones"))  # one row
    return number_rows(rows, [], ["annotated", "name", "zone_id"], "place").join(F.broadcast(totals))


def list_zones(zones: DataFrame) -> DataFrame:
    """Zones from the bottom of each area up; those of unknown height first."""
    return zones.orderBy("area", F.asc_nulls_first("vertical_index"), "zone_id")


def item_zone(items: DataFrame, zones: DataFrame) -> DataFrame:
    """The items with the ``zone_name`` and ``zone_label`` of where they are now, NULL where that is unknown."""
    labels = zones.select("zone_id", F.col("name").alias("zone_name"), F.col("label").alias("zone_label"))
    return items.hint("shuffle_merge").join(labels, "zone_id", "left")


def validate_category(rows: DataFrame, column: str = "category") -> DataFrame:
    """The rows with the category in lower case and trimmed, NULL where it is none, and ``reject_reason``."""
    clean = F.lower(F.trim(column))
    known = F.coalesce(clean.isin(*CATEGORIES), F.lit(False))
    reason = F.when(F.coalesce(clean, F.lit("")) == "", "no category").when(~known, F.concat(F.lit("unknown category: "), clean))
    return rows.withColumn("reject_reason", reason).withColumn(column, F.when(known, clean))


def list_entries(entries: DataFrame, system: str | None = None, since: str | None = None, until: str | None = None, text: str | None = None) -> DataFrame:
    """Log entries, newest first: exact system, inclusive dates compared as ISO text, literal text."""
    out = entries
    if system:
        out = out.where(F.col("system") == system)
    if since:
        out = out.where(F.col("date") >= since)
    if until:
        out = out.where(F.col("date") <= until)
    if text:
        out = out.where(text_contains_any(F.lit(text), F.col("content"), F.col("metadata")))
    return out.orderBy(F.desc_nulls_last("date"), "entry_id")


def entry_filename(entries: DataFrame) -> DataFrame:
    """file_name: day and slug; a repeated name gets -2, -3 …, and identical content reuses the first."""
    named = entries.dropDuplicates(["date", "content"]).withColumn("_base", F.concat_ws("-", "date", slugify(F.col("content"))))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("entry_id"))
    return named.withColumn("_n", nth).withColumn("file_name", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(".md"))).drop("_base", "_n")


def render_entry(fields: list[str], body: str = "content") -> Column:
    """Front matter and text of a record; NULL fields are written as null."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(yaml_quote(F.col(f).cast("string")), F.lit("null"))) for f in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.col(body))


def vocabulary(sources: list[DataFrame], limit: int = 60) -> DataFrame:
    """term, priority: the first ``limit`` different terms, by the place of their source and then alphabetically."""
    every = None
    for n, s in enumerate(sources):
        part = s.select(F.trim(s.columns[0]).alias("term"), F.lit(n).alias("priority")).where("term <> ''")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("term").agg(F.min("priority").alias("priority")).orderBy("priority", "term").limit(limit)


def modal_model(chunks: DataFrame) -> DataFrame:
    """The most common model, ties by name."""
    return chunks.groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").limit(1)


def model_mismatch(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """model (the corpus's most common), asked (the one of ``config``, a single row), mismatch; an empty corpus has none."""
    asked = config.select(F.col("model").alias("asked"))
    both = modal_model(chunks).select("model").join(F.broadcast(asked))  # one row each
    return both.withColumn("mismatch", ~F.col("model").eqNullSafe(F.col("asked")))


def list_items(items: DataFrame, zones: DataFrame, zone: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    """Items with the label of their zone, by name; all given filters hold. Text is looked for in name and aliases."""
    labels = zones.select("zone_id", F.col("slug").alias("zone_slug"), F.col("label").alias("zone_label"))
    out = items.hint("shuffle_merge").join(labels, "zone_id", "left")
    if zone:
        out = out.where(F.col("zone_slug") == zone)
    if category:
        out = out.where(F.col("category") == category)
    if text:
        out = out.where(text_contains_any(F.lit(text), F.col("name"), F.col("aliases")))
    return out.orderBy("name")


def entry_display(date: Column, system: Column, title: Column, cost: Column, currency: Column) -> Column:
    """One line of a log entry: a dash for what is missing, the currency NZD where none is given."""
    shown = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "—").otherwise(c)
    price = F.when(cost.isNull(), "—").otherwise(F.concat_ws(" ", F.format_string("%.2f", cost), F.coalesce(currency, F.lit("NZD"))))
    return F.concat_ws("  ", shown(date), shown(system), shown(title), price)


def phrase_highlights(retrieved: DataFrame, items: DataFrame, deviations: DataFrame) -> DataFrame:
    """query_id, zone_id, first_rank, kind for retrieved chunks (query_id, pos, item_id, deviation_id): the zones of
    the records that they come from; chunks without a record, and records without a zone, have none."""
    kept = lambda c: retrieved.where(F.col(c).isNotNull()).select("query_id", F.col("pos").alias("rank"), c)
    placed = lambda t, c: t.where("zone_id IS NOT NULL").select(c, "zone_id")
    things = kept("item_id").hint("shuffle_merge").join(placed(items, "item_id"), "item_id").select("query_id", "zone_id", "rank", F.lit("inventory").alias("kind"))
    faults = kept("deviation_id").hint("shuffle_merge").join(placed(deviations, "deviation_id"), "deviation_id").select("query_id", "zone_id", "rank", F.lit("deviation").alias("kind"))
    return zone_highlights(things.unionByName(faults))


def zone_highlights(hits: DataFrame) -> DataFrame:
    """query_id, zone_id, first_rank, kind: zones of retrieved records; a deviation beats an inventory hit."""
    return hits.where("zone_id IS NOT NULL").groupBy("query_id", "zone_id").agg(F.min("rank").alias("first_rank"), F.when(F.max((F.col("kind") == "deviation").cast("int")) == 1, "deviation").otherwise("inventory").alias("kind"))
