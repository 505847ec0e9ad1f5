from hybridkb.llm.line_dedup import dedup_lines


def test_runs_of_short_lines_go_from_rows_without_id(spark):
    run = "one two\nthree four\nfive six"
    docs = spark.createDataFrame([(1, run), (2**63 - 1, f"a b\n{run}"), (None, f"x\n{run}\ny"), (None, f"z\n{run}")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(docs).collect()) == sorted([run, "a b", "x\ny", "z"])
