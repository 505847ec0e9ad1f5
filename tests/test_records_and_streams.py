import hashlib
import unicodedata

from pyspark.sql import functions as F

from hybridkb.functions import dates, text
from hybridkb.operators import chunking, pages, payloads, records
from hybridkb.sources import tables, versions
from hybridkb.streaming import ops


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dates(spark):
    ref = F.lit("2026-05-30").cast("date")
    for raw, want in [("2024-03-15", "2024-03-15"), ("03/04/2024", "2024-04-03"), (None, "2026-05-30"), ("yesterday", "2026-05-29"), ("sometime in the winter", "2026-05-30"), ("Saturday", "2026-05-23")]:
        assert one(spark, dates.normalise_date(F.lit(raw).cast("string"), ref)) == want


def test_names_and_systems(spark):
    for raw, want in [(" RIGGING ", "rigging"), ("the deck pump", "hull/deck"), ("deckhand", "other"), ("anchor tackle", "other"), ("sails and rigging", "rigging"), (None, "other")]:
        assert one(spark, records.normalise_system(F.lit(raw).cast("string"))) == want
    for raw, want in [("Harness", "safety"), (" hand tool", "tool"), ("provision", "provision"), ("a hand tool", "spare"), (None, "spare")]:
        assert one(spark, records.normalise_category(F.lit(raw).cast("string"))) == want
    for raw, want in [('so {"k": "{", "m": [{}]} and {', '{"k": "{", "m": [{}]}'), ('{"k": 1}', '{"k": 1}'), ("none", "none"), ('{"k": "\\"}"} tail {"z": 2}', '{"k": "\\"}"}')]:
        assert one(spark, text.first_json_object(F.lit(raw))) == want
    assert one(spark, text.yaml_unquote(text.yaml_quote(F.lit("a # b")))) == "a # b"


def test_chat_headers(spark):
    good = {"1/2/24, 7:05 - x": ("1/2/24", "7:05", "x"), "[31.12.2023, 23:59:01] y: z": ("31.12.2023", "23:59:01", "y: z"), "05-06-2024, 8:00 pm - q": ("05-06-2024", "8:00 pm", "q")}
    bad = ["[1/2/24, 7:05 - x", "1/2/24, 7:05] x", "123/2/24, 7:05 - x", "1/2/2, 7:05 - x", "1/2/24 7:05 - x", "1/2/24, 7:5 - x", "1/2/24, 7 - x", " 1/2/24, 7:05 - x", "1/2/24, 7:05", ""]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "line string").select("line", chunking.chat_header(F.col("line")).alias("h"))
    got = {r.line: r.h and tuple(r.h) for r in df.collect()}
    assert got == good | dict.fromkeys(bad)
    for path, want in [("a/b/WhatsApp Chat with Crew.zip", "Crew"), ("Night watch.2024.txt", "Night watch.2024"), ("c/.hidden", ".hidden")]:
        assert one(spark, chunking.chat_name(F.lit(path))) == want


def test_chat_lines(spark):
    lines = ["before any header", "7/8/2023, 10:00 - Eve: a: b", "second line", "", "7/8/2023, 10:01 - Eve added Kim", "still Eve's", "7/8/2023, 10:02 -  : no one", "[7/8/2023, 10:03:00] Kim: <Media omitted>", "[7/8/2023, 10:04:00] Kim: left"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "chat_id long, line_no long, line string")
    got = [(r.sender, r.body) for r in chunking.chat_lines(df).orderBy("seq").collect()]
    assert got == [("Eve: a", "b\nsecond line\n\nstill Eve's"), ("Kim", "[media]")]


def test_markdown(spark):
    df = spark.createDataFrame([(1, "lead\n# A\n#### D\n\none. two.\n## B\n\n# C\nthree\n#no heading\n")], "doc_id long, text string")
    rows = chunking.markdown_sections(df).orderBy("ordinal").collect()
    assert [(r.section_path, r.content) for r in rows] == [("Preamble", "lead"), ("# A > #### D", "# A\n#### D\n\none. two."), ("# C", "# C\n\nthree\n#no heading")]


def test_packing(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}." for i in range(500)),)], "t string")
    parts = df.select(chunking.pack_sentences(F.col("t")).alias("p"), pages.pack_words(F.col("t")).alias("q")).first()
    for p in (parts.p, parts.q):
        assert " ".join(p).split() == [f"w{i}." for i in range(500)]


def test_pages(spark):
    toc = spark.createDataFrame([(1, 0, 1, "A", 2), (1, 1, 2, "B", 3), (1, 2, 1, "C", 5)], "doc_id long, seq int, level int, title string, page int")
    p = spark.createDataFrame([(1, n) for n in range(1, 7)], "doc_id long, page int")
    assert [r.section_path for r in pages.toc_section(p, toc).orderBy("page").collect()] == ["Page 1", "A", "A > B", "A > B", "C", "C"]


def test_contents_with_skipped_levels_and_empty_pages(spark):
    toc = spark.createDataFrame([(1, 0, 2, "b", 2), (1, 1, 4, "d", 2), (1, 2, 3, "c", 4), (1, 3, 1, "a", 9)], "doc_id long, seq int, level int, title string, page int")
    p = spark.createDataFrame([(1, n, "" if n == 3 else f" page {n}. " + "word " * (n * 60)) for n in range(1, 6)] + [(2, 1, "alone")], "doc_id long, page int, text string")
    raw = pages.toc_chunks(p, toc)
    assert [(r.doc_id, r.page_start, r.section_path) for r in raw.orderBy("doc_id", "page_start").collect()] == [(1, 1, "Page 1"), (1, 2, "b > d"), (1, 4, "b > c"), (1, 5, "b > c"), (2, 1, "Page 1")]
    done = pages.finalise_chunks(raw).orderBy("doc_id", "section_path", "section_ordinal").collect()
    assert all(r.token_count <= 200 for r in done)
    for key in {(r.doc_id, r.section_path) for r in done}:
        part = [r for r in done if (r.doc_id, r.section_path) == key]
        assert [r.section_ordinal for r in part] == list(range(len(part)))
        whole = " ".join(r.text for r in p.orderBy("page").collect() if (r.doc_id, key[1]) in {(x.doc_id, x.section_path) for x in part if x.page_start == r.page})
        assert " ".join(r.content for r in part).split() == whole.split()


def test_caps_count_the_body_only(spark):
    df = spark.createDataFrame([(1, ["w " * 50, "x. " * 3]), (2, ["y " * 12]), (3, ["a. " * 9]), (4, [])], "doc_id long, parts array<string>")
    got = {r.doc_id: (r.n_parts, r.n_over) for r in chunking.token_cap(df, 10).collect()}
    assert got == {1: (2, 0), 2: (1, 0), 3: (1, 1), 4: (0, 0)}


def test_found_items_are_those_that_hold_the_question(spark):
    items = [(1, "Deck Ring", None), (2, "ring", "a%b"), (3, None, None), (4, "xy", "z")]
    questions = [(1, "RING"), (2, "k r"), (3, "%"), (4, "z"), (5, ""), (6, None), (7, "ringing")]
    got = {(r.query_id, r.item_id) for r in records.find_items(spark.createDataFrame(items, "item_id long, a string, b string"), spark.createDataFrame(questions, "query_id long, text string"), ["a", "b"]).collect()}
    assert got == {(q, i) for q, t in questions if t is not None for i, *f in items if any(t.lower() in x.lower() for x in f if x is not None)}


def test_payload_ladder(spark):
    df = spark.createDataFrame([("nope", '{"system": "sails", "parts": 3}'), ('```json\n{"cost_amount": "x", "parts": ["a", " "]}\n```', None), (None, None)], "a string, b string")
    got = [(r.rung, r.record.system, r.record.cost_amount, r.record.parts) for r in payloads.extraction_ladder(df, "a", "b").collect()]
    assert got == [("retry", "sails", None, []), ("first", "other", None, ["a"]), ("default", "other", None, [])]


def test_upsert_is_a_no_op_the_second_time(spark):
    old = spark.createDataFrame([("shared", "a", "1"), ("shared", "b", "1")], "layer string, path string, content_hash string")
    new = spark.createDataFrame([("shared", "a", "1"), ("shared", "b", "2"), ("shared", "c", "1")], "layer string, path string, content_hash string")
    once = tables.upsert_source(old, new)
    assert sorted(map(tuple, once.collect())) == [("shared", "a", "1"), ("shared", "b", "2"), ("shared", "c", "1")]
    assert tables.detect_changes(new, once).where("status <> 'no-op'").count() == 0


def test_nfc_scan_and_sink(spark, tmp_path):
    for raw in ("e\u0301a", "plain", "\u212b"):
        assert one(spark, text.nfc(F.lit(raw))) == unicodedata.normalize("NFC", raw)
    assert one(spark, text.content_fingerprint(F.lit("\ufeffe\u0301\r\nx"))) == hashlib.sha256("\u00e9\nx".encode()).hexdigest()
    (tmp_path / "in").mkdir()
    for name in ("a.md", "b.exe"):
        (tmp_path / "in" / name).write_text("x")
    kept, skipped = tables.corpus_scan(spark, str(tmp_path / "in"))
    assert kept.count() == skipped.count() == 1
    chunks = spark.createDataFrame([(1, "shared", "x y"), (2, "vessel", "z")], "chunk_id long, layer string, content string")
    versions.publish(tables.embed_attach(chunks, lambda texts: [[1.0, 2.0] for _ in texts], 2), str(tmp_path / "out"))
    assert versions.read_table(spark, str(tmp_path / "out"), ["shared"]).select("embedding").first()[0] == [1.0, 2.0]


def arrive(spark, folder, schema, parts, step):
    """Each part is written and then seen by a run of its own."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        step(spark.readStream.schema(schema).parquet(folder))


def test_stream_of_moves_goes_on_from_its_checkpoint(spark, tmp_path):
    out = []

    def step(stream):
        with ops.rocksdb_state(spark):
            q = ops.stream_moves(stream).writeStream.foreachBatch(lambda b, i: out.append({r.user_id: (r.n_moves, r.n_late, r.current, r.latest) for r in b.collect()}))
            q.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    parts = [[(1, 1, "a"), (1, 3, "b"), (1, 2, "a"), (2, 4, None)], [(1, 5, "b"), (1, 6, "c"), (2, 7, "x")], [(1, 4, "z"), (1, 8, "d"), (1, 9, "e"), (1, 9, "f")]]
    arrive(spark, str(tmp_path / "in"), "user_id long, event_id long, place string", parts, step)
    assert out == [{1: (1, 0, "b", ["a"]), 2: (0, 0, None, [])}, {1: (2, 0, "c", ["b", "a"]), 2: (1, 0, "x", [None])}, {1: (4, 2, "e", ["d", "c", "b"])}]


def test_late_messages_are_dropped_and_counted(spark, tmp_path):
    dropped = []

    def step(stream):
        q = ops.stream_sessions(stream.withColumn("ts", F.to_timestamp("t"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query = q.trigger(availableNow=True).start()
        query.awaitTermination()
        dropped.append(ops.dropped_late(query))

    at = lambda *x: [(u, f"2024-01-01 {t}:00") for u, t in x]
    parts = [at((1, "10:40"), (1, "10:00"), (1, "10:30")), at((1, "10:45"), (2, "12:00")), at((1, "09:00"), (1, "11:20"), (1, "10:29")), [(9, "2024-02-01 00:00:00")]]
    arrive(spark, str(tmp_path / "in"), "user_id long, t string", parts, step)
    assert dropped == [0, 0, 2, 0]
    got = sorted((r.user_id, f"{r.start:%H:%M}", r.n_messages) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "10:00", 4), (1, "11:20", 1), (2, "12:00", 1)]


def test_ingest_again_publishes_changes_only(spark, tmp_path):
    table = str(tmp_path / "table")
    parts = [[("shared", "a", "1", 1), ("vessel", "b", "1", 2)], [("shared", "a", "1", 3), ("vessel", "b", "2", 5), ("vessel", "b", "3", 4)], [("shared", "a", "1", 6)]]
    seen = []

    def step(stream):
        ops.stream_ingest(stream, table, str(tmp_path / "state")).awaitTermination()
        seen.append((versions.listing(spark, table)["version"], sorted((r.path, r.content_hash) for r in versions.read_table(spark, table).collect())))

    arrive(spark, str(tmp_path / "in"), "layer string, path string, content_hash string, seq long", parts, step)
    assert seen == [(1, [("a", "1"), ("b", "1")]), (2, [("a", "1"), ("b", "2")]), (2, [("a", "1"), ("b", "2")])]


def test_moves_read_and_write_a_key_once():
    """A key costs one call to read its state and one to write it."""
    from pyspark.sql import Row

    from hybridkb.streaming.ops import Moves

    class Value:
        def __init__(self):
            self.held, self.calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def __init__(self):
            self.values = {}

        def getValueState(self, name, schema, ttl=None):
            return self.values.setdefault(name, Value())

    handle, moves = Handle(), Moves()
    moves.init(handle)
    rows = lambda *pairs: iter([Row(event_id=i, place=p) for i, p in pairs])
    first = list(moves.handleInputRows((7,), rows((3, "b"), (1, "a"), (2, None)), None))
    assert [r.asDict() for r in first] == [{"user_id": 7, "n_moves": 2, "n_late": 0, "current": "b", "latest": [None, "a"]}]
    again = list(moves.handleInputRows((7,), rows((3, "c"), (None, "d"), (4, "c"), (5, "c")), None))
    assert [r.asDict() for r in again] == [{"user_id": 7, "n_moves": 3, "n_late": 2, "current": "c", "latest": ["b", None, "a"]}]
    assert [v.calls for v in handle.values.values()] == [["get", "update"] * 2]
