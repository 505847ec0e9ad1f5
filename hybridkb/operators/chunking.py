"""Text to chunks: blocks, markdown sections, sentence packing, chat lines and sessions, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.functions.text import token_count, words
from hybridkb.operators.numbering import number_rows

TOKEN_CAP = 200
GAP = 30 * 60
# Bodies that chat applications write themselves begin with these.
SYSTEM_PREFIXES = (
    "Messages and calls are end-to-end encrypted", "joined using this group", "left", "added", "removed", "changed the group", "created group",
    "changed their phone number", "Your security code with", "This message was deleted", "You deleted this message", "Waiting for this message", "null",
)
# The two forms of a message's first line in chat exports, with day, time and the rest.
PLAIN_HEADER = r"^(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)\s*-\s*(.+)"
BRACKET_HEADER = r"^\[(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}),\s*(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)\]\s*(.+)"


def chat_header(line: Column) -> Column:
    """A struct of day, time and payload, or NULL for a line that begins no message."""
    names = ("day", "time", "payload")

    def parts(form: str) -> Column:
        return F.when(line.rlike(form), F.struct(*[F.regexp_extract(line, form, k).alias(n) for k, n in enumerate(names, 1)]))

    return F.coalesce(parts(PLAIN_HEADER), parts(BRACKET_HEADER))


def chat_name(path: Column) -> Column:
    """A chat's name: the file's, without folder, suffix and the words that exports begin with."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    lead = "WhatsApp Chat with "
    return F.when(stem.startswith(lead), F.substring(stem, F.lit(len(lead) + 1), F.length(stem))).otherwise(stem)


def split_sentences(text: Column) -> Column:
    """Sentences: cut after a full stop and white space."""
    return F.filter(F.split(text, r"(?<=\.)\s+"), lambda x: F.trim(x) != "")


def pack_sentences(text: Column, cap: int = TOKEN_CAP) -> Column:
    """Greedy parts of at most ``cap`` tokens; a longer single sentence stays whole. The fold carries the word
    and mark counts of the open part, so no text is counted twice."""
    sizes = F.transform(split_sentences(text), lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("w"), F.regexp_count(s, F.lit(r"[^\p{L}\p{N}_\s]")).alias("p")))
    zero = F.expr("named_struct('done', cast(array() AS array<array<string>>), 'open', cast(array() AS array<string>), 'w', 0, 'p', 0)")

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (a["w"] + x["w"] + F.floor((a["p"] + x["p"]) / 2) > cap)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["s"])).otherwise(F.concat(a["open"], F.array(x["s"]))).alias("open"),
            F.when(full, x["w"]).otherwise(a["w"] + x["w"]).alias("w"),
            F.when(full, x["p"]).otherwise(a["p"] + x["p"]).alias("p"),
        )

    parts = F.aggregate(sizes, zero, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return F.transform(parts, lambda p: F.array_join(p, " "))


def blank_line_blocks(documents: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """doc_id, ordinal, section_path, content: blocks between blank lines, packed; a section is named by the
    date it begins with, else "Block n" with the number of chunks so far."""
    blocks = documents.select("doc_id", F.posexplode(F.split("text", r"\n{2,}")).alias("block_no", "block")).where(F.trim("block") != "")
    parts = blocks.select("doc_id", "block_no", F.regexp_extract(F.trim("block"), r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})", 1).alias("day"), pack_sentences(F.trim("block"), cap).alias("parts"))
    before = F.coalesce(F.sum(F.size("parts")).over(Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = parts.withColumn("before", before.cast("int"))
    section = F.when(F.col("day") != "", F.col("day")).otherwise(F.concat(F.lit("Block "), F.col("before").cast("string")))
    return named.select("doc_id", "before", section.alias("section_path"), F.posexplode("parts").alias("i", "content")).select("doc_id", (F.col("before") + F.col("i")).alias("ordinal"), "section_path", "content")


def heading_ancestors(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, line, level (NULL for text), section_no, path: the live headings at every line."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    lines = lines.withColumn("level", F.when(F.length(mark) > 0, F.length(mark)))
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section_no", F.count("level").over(run))
    last = {n: F.max(F.when(F.col("level") == n, F.struct("line_no", F.trim("line").alias("h")))).over(run) for n in range(1, 7)}
    for n, c in last.items():
        lines = lines.withColumn(f"h{n}", c)
    # A heading of level n ends those of deeper levels that came before it.
    alive = []
    for n in range(1, 7):
        above = [F.col(f"h{m}.line_no") for m in range(1, n)]
        ok = F.col(f"h{n}.line_no") > F.coalesce(F.greatest(*above) if len(above) > 1 else above[0], F.lit(-1)) if above else F.lit(True)
        alive.append(F.when(F.col(f"h{n}").isNotNull() & ok, F.col(f"h{n}.h")))
    path = F.concat_ws(" > ", *alive)
    return lines.select("doc_id", "line_no", "line", "level", "section_no", F.when(path == "", "Preamble").otherwise(path).alias("path"))


def markdown_sections(documents: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """doc_id, ordinal, section_path, content: sections under their headings; heading-only sections drop out;
    the headings stand before each part and do not count towards the cap."""
    body = heading_ancestors(documents).where("level IS NULL")
    sections = body.groupBy("doc_id", "section_no", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    sections = sections.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where("body <> ''")
    parts = sections.select("doc_id", "section_no", "path", F.posexplode(pack_sentences(F.col("body"), cap)).alias("part", "content"))
    head = F.when(F.col("path") == "Preamble", F.col("content")).otherwise(F.concat(F.replace("path", F.lit(" > "), F.lit("\n")), F.lit("\n\n"), "content"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "part")) - 1
    return parts.select("doc_id", nth.alias("ordinal"), F.col("path").alias("section_path"), head.alias("content"))


def section_ordinal(chunks: DataFrame) -> DataFrame:
    """The chunks with a counter from 0 inside each (doc_id, section_path)."""
    return number_rows(chunks, ["doc_id", "section_path"], ["ordinal"], "section_ordinal")


def gap_sessions(messages: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", gap: int = GAP) -> DataFrame:
    """The messages with ``session`` from 0: a new one where more than ``gap`` seconds passed since the message
    before, in file order; a missing or earlier time stamp starts none."""
    w = Window.partitionBy(key).orderBy(order)
    passed = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    flag = F.when(passed > gap * 1_000_000, 1).otherwise(0)
    return messages.withColumn("_new", flag).withColumn("session", F.sum("_new").over(w)).drop("_new")


def message_lines(lines: DataFrame) -> DataFrame:
    """chat_id, line_no, line, day, time, sender, body, kept, owner of all lines but headers that are dropped: ``owner``
    counts the kept headers (those with a sender, whose body the application did not write) up to the line, so
    a line without a header belongs to the latest kept message. Lines before the first one are dropped. Payloads are
    cut at the last ": "."""
    parsed = lines.withColumn("head", chat_header(F.col("line"))).select("chat_id", "line_no", "line", "head.*")
    header = F.col("day").isNotNull()
    sender, body = F.regexp_extract("payload", r"(?s)^(.*): (.*)$", 1), F.regexp_extract("payload", r"(?s)^(.*): (.*)$", 2)
    system = F.lit(False)
    for p in SYSTEM_PREFIXES:
        system = system | body.startswith(p)
    kept = F.coalesce(header & F.contains("payload", F.lit(": ")) & (F.trim(sender) != "") & ~system, F.lit(False))
    parsed = parsed.select("chat_id", "line_no", "line", "day", "time", sender.alias("sender"), F.when(body == "<Media omitted>", "[media]").otherwise(body).alias("body"), header.alias("header"), kept.alias("kept"))
    owner = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("chat_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return parsed.withColumn("owner", owner.cast("int")).where("(kept OR NOT header) AND owner > 0").drop("header")


def continuation_owner(lines: DataFrame) -> DataFrame:
    """chat_id, line_no, owner: the lines that continue a message, with the message's ``seq``."""
    return message_lines(lines).where("NOT kept").select("chat_id", "line_no", "owner")


def chat_lines(lines: DataFrame) -> DataFrame:
    """chat_id, seq, day, time, sender, body: header lines start messages, other lines continue the last kept one."""
    piece = F.when(F.col("kept"), F.col("body")).otherwise(F.col("line"))
    first = lambda c: F.max(F.when(F.col("kept"), F.col(c))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))), lambda x: x["piece"]), "\n")
    return message_lines(lines).groupBy("chat_id", F.col("owner").alias("seq")).agg(first("day"), first("time"), first("sender"), text.alias("body"))


def chat_chunks(messages: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """chat_id, session, part, n_messages, content: "sender: body" lines of a session, cut where the next line
    would exceed the cap. The fold runs inside a session."""
    line = F.concat("sender", F.lit(": "), "body")
    rows = messages.select("chat_id", "session", "seq", F.struct("seq", line.alias("line"), token_count(line).alias("n")).alias("m"))
    sessions = rows.groupBy("chat_id", "session").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    zero = F.expr("named_struct('done', cast(array() AS array<array<string>>), 'open', cast(array() AS array<string>), 'n', 0)")

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (a["n"] + x["n"] > cap)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["line"])).otherwise(F.concat(a["open"], F.array(x["line"]))).alias("open"),
            F.when(full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
        )

    parts = F.aggregate("ms", zero, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return sessions.select("chat_id", "session", F.posexplode(parts).alias("part", "lines")).select("chat_id", "session", "part", F.size("lines").alias("n_messages"), F.array_join("lines", "\n").alias("content"))


def front_matter(documents: DataFrame) -> DataFrame:
    """doc_id, fields (map of the scalar keys), body: a block between --- lines at the top; quoted values are
    unescaped, null and empty values are NULL."""
    block = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---(?:\n|$)(.*)$", 1)
    body = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---(?:\n|$)(.*)$", 2)
    has = F.col("text").rlike(r"(?s)^---\n.*?\n---(?:\n|$)")
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))

    def entry(x: Column) -> Column:
        value = F.trim(F.regexp_extract(x, r"^[A-Za-z_][A-Za-z0-9_]*:(.*)$", 1))
        plain = F.when(value.rlike('^".*"$'), F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('\\"'), F.lit('"'))).when(value.isin("", "null", "~"), None).otherwise(value)
        return F.struct(F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_]*):", 1).alias("key"), plain.alias("value"))

    fields = F.map_from_entries(F.transform(pairs, entry))
    return documents.select("doc_id", F.when(has, fields).alias("fields"), F.when(has, body).otherwise(F.col("text")).alias("body"))


def deviation_chunk(documents: DataFrame) -> DataFrame:
    """doc_id, section_path, content, section_ordinal, token_count, deviation_id, zone_id: one chunk of a deviation's
    file; ids that are no whole numbers are NULL."""
    f = front_matter(documents)
    number = lambda c: F.trim(F.col("fields")[c]).try_cast("int")
    return f.select("doc_id", F.lit("Factory Deviation").alias("section_path"), F.col("body").alias("content"), F.lit(0).alias("section_ordinal"), token_count(F.col("body")).alias("token_count"), number("deviation_id").alias("deviation_id"), number("zone_id").alias("zone_id"))


def token_cap(parts: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """doc_id, n_parts, n_over, largest of packed bodies (doc_id, parts): no part is over the cap, but for single
    sentences that are longer; headings that are put before a part do not count."""
    sizes = F.transform("parts", token_count)
    alone = F.transform("parts", lambda p: F.size(split_sentences(p)))
    return parts.select("doc_id", F.size("parts").alias("n_parts"), F.size(F.filter(F.arrays_zip(sizes.alias("n"), alone.alias("s")), lambda x: (x["n"] > cap) & (x["s"] > 1))).alias("n_over"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("largest"))
