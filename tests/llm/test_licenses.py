from hybridkb.llm.licenses import TEMPLATES, license_matches, scan_licenses


def test_lines_blocks_and_whole_texts(spark):
    docs = spark.createDataFrame(
        [(1, "intro\nReleased under the MIT license!\nmore text"), (2, TEMPLATES["ISC"].replace(" and ", " AND ")), (3, "x y\n\n" + TEMPLATES["MIT"].replace(", ", ",\n") + "\n\nend here"), (4, "Permission is hereby granted to nobody at all")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert got[1].licenses == ["MIT-notice"] and got[2].licenses == ["ISC"] and got[3].licenses == ["MIT"] and got[4].licenses == []
    units = {r.doc_id: [m.unit for m in r.matches] for r in license_matches(docs).collect()}
    assert units[1] == ["line"] and units[3][0] == "block"


def test_odd_rows(spark, odd_documents, no_documents):
    assert scan_licenses(odd_documents).where("n_matches > 0").count() == 0
    assert scan_licenses(odd_documents).count() == odd_documents.count()
    assert scan_licenses(no_documents).count() == 0
    own = spark.createDataFrame([("own", "one two three"), (None, "x y"), ("none", None)], "license_id string, text string")
    assert {r.doc_id for r in scan_licenses(odd_documents, own).where("n_matches > 0").collect()} == {8}
