"""Small operators on odd values: missing, blank, repeated and out of range."""

import json

from pyspark.sql import functions as F

from hybridkb.functions import text
from hybridkb.operators import chunking, pages, records
from hybridkb.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_page_selection(spark):
    specs = {"61-63,65": [61, 62, 63, 65], "3,1-2, 2": [1, 2, 3], "0": None, "-3": None, "63-61": None, "abc": None, "61.5": None, "": None, None: None, "1,": None, "99999999999": None}
    df = spark.createDataFrame([(k, s) for k, s in enumerate(specs)], "k int, spec string")
    got = {r.spec: (r.pages, r.reason) for r in pages.page_selection(df).collect()}
    assert {s: p for s, (p, _) in got.items()} == specs
    assert got["0"][1] == got["63-61"][1] == "out of order" and got[None][1] == got["-3"][1] == "not a page"
    asked = spark.createDataFrame([(1, "1-2,9"), (1, "2"), (2, "x"), (3, None)], "doc_id int, spec string")
    held = spark.createDataFrame([(d, p, f"{d}{p}") for d in (1, 2, 3) for p in (1, 2, 3)], "doc_id int, page int, t string")
    assert sorted(r.t for r in pages.selected_pages(asked, held).collect()) == ["11", "12"]


def test_grids(spark):
    zones = spark.createDataFrame([(1, 2, 2, "top bottom"), (2, 0, 3, "x"), (3, None, 1, None), (4, 1, 1, None)], "zone_id int, r int, c int, names string")
    grid = records.sub_slot_grid(zones, F.col("r"), F.col("c"), F.split("names", " "))
    assert sorted(tuple(r) for r in grid.select("zone_id", "row", "col").collect()) == [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (4, 1, 1)]
    assert {r.row_label for r in grid.where("zone_id = 1").collect()} == {"top", "bottom"} and grid.where("zone_id = 4").first().row_label is None
    assert {r.zone_id: (r.n_slots, r.n_rows, r.n_cols) for r in records.grid_counts(grid).collect()} == {1: (4, 2, 2), 4: (1, 1, 1)}


def test_annotation_list(spark):
    zones = spark.createDataFrame([(1, "b", "p", "g"), (2, "a", "p", "g"), (3, "z", None, "g"), (4, "c", "p", None), (5, "c", None, None)], "zone_id int, name string, schematic_image string, geometry string")
    rows = records.annotation_progress(zones).orderBy("place").collect()
    assert [(r.zone_id, r.place, r.annotated) for r in rows] == [(4, 0, False), (5, 1, False), (3, 2, False), (2, 3, True), (1, 4, True)]
    assert {(r.n_annotated, r.n_zones) for r in rows} == {(2, 5)}
    assert records.annotation_progress(zones.limit(0)).collect() == []


def test_categories_and_metadata(spark):
    df = spark.createDataFrame([(" Spare ",), ("boat",), ("",), (None,), ("TOY",)], "category string")
    got = [(r.category, r.reject_reason) for r in records.validate_category(df).collect()]
    assert got == [("spare", None), (None, "unknown category: boat"), (None, "no category"), (None, "no category"), ("toy", None)]
    lit = lambda x: F.lit(x).cast("string")
    assert json.loads(one(spark, text.item_metadata(lit("22-4"), lit(None), lit(" "), lit("2024-01-01")))) == {"part_number": "22-4", "last_inspected": "2024-01-01"}
    assert one(spark, text.item_metadata(*[lit(None)] * 4)) == "{}"


def test_json_helpers(spark):
    assert one(spark, text.json_field(F.lit('{"k": 1}'), "k")) == "1" and one(spark, text.json_field(F.lit("no"), "k")) is None
    assert [one(spark, text.json_valid(F.lit(x).cast("string"))) for x in ('{"a": []}', "{", None, "1")] == [True, False, False, True]
    assert [one(spark, text.safe_json(F.lit(x).cast("string"))) for x in ('{"a": "b"}', "[1]", None)] == [{"a": "b"}, {}, {}]


def test_continuation_lines_belong_to_the_latest_kept_message(spark):
    lines = ["early", "1/2/24, 7:05 - Eve: one", "more", "1/2/24, 7:06 - Eve: left", "after a dropped header", "[1/2/24, 7:07:00 PM] Kim: two", "end"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "chat_id int, line_no int, line string")
    assert sorted((r.line_no, r.owner) for r in chunking.continuation_owner(df).collect()) == [(2, 1), (4, 1), (6, 2)]


def test_groups_of_sources(spark):
    df = spark.createDataFrame([(1, "shared", "b"), (2, "shared", "a"), (3, "vessel", "z"), (4, "attic", "q")], "source_id int, layer string, path string")
    assert sorted((r.layer_rank, r.layer, r.n_sources, r.first_path) for r in tables.explore_groups(df).collect()) == [(1, "vessel", 1, "z"), (2, "shared", 2, "a")]


def test_headings_of_pages(spark):
    spans = [(1, 0, 0, 18.0, "Serif", "Title"), (1, 0, 1, 10.0, "Serif", "body"), (1, 0, 2, 10.0, "Bold", "short"), (1, 0, 3, 10.0, "Bold", "x" * 90), (1, 0, 4, 18.0, "Serif", " "), (1, 1, 0, 18.0, "Serif", "alone")]
    df = spark.createDataFrame(spans, "doc_id int, page int, span_no int, size double, font string, text string")
    got = {(r.page, r.span_no) for r in pages.span_headings(df).where("heading").collect()}
    assert got == {(0, 0), (0, 2)}
