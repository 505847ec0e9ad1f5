"""Tables in versions: what readers see when runs end, die, or meet."""

from pathlib import Path

import pytest

from hybridkb.sources import versions

SCHEMA = "path string, layer string, content_hash string, n int"
ROWS = [("a", "shared", "1", 1), ("b", "vessel", "1", 2), ("c", "vessel", "1", 3), ("d", "community", "1", 4)]


def rows_of(df):
    return sorted((r.path, r.layer, r.content_hash, r.n) for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    versions.publish(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_layers_are_read_by_their_folders(spark, folder):
    assert rows_of(versions.read_table(spark, folder)) == sorted(ROWS)
    some = versions.read_table(spark, folder).where("layer = 'vessel'").select("path")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "(layer" in plan.split("PartitionFilters", 1)[1]
    only = versions.read_table(spark, folder, ["shared"])
    assert all("layer=shared" in f for f in only.inputFiles()) and rows_of(only) == [ROWS[0]]
    assert versions.read_table(spark, folder, ["attic"]).collect() == []


def test_a_run_that_dies_before_the_switch_changes_nothing(spark, folder, monkeypatch):
    def dies(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(versions, "_switch", dies)
        versions.publish(spark.createDataFrame([("z", "shared", "9", 9)], SCHEMA), folder)
    assert Path(folder, "data", "version=2").exists()
    assert rows_of(versions.read_table(spark, folder)) == sorted(ROWS)
    assert versions.publish(spark.createDataFrame([("y", "shared", "8", 8)], SCHEMA), folder, ["shared"]) == 3
    assert rows_of(versions.read_table(spark, folder)) == sorted([*ROWS[1:], ("y", "shared", "8", 8)])
    assert versions.clean_up(spark, folder) == [2]
    assert rows_of(versions.read_table(spark, folder, ["vessel"])) == sorted(ROWS[1:3])


def test_a_run_that_dies_while_it_writes_changes_nothing(spark, folder):
    half = Path(folder, "data", "version=2", "layer=shared")
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"PAR1 half of a file")
    assert rows_of(versions.read_table(spark, folder)) == sorted(ROWS)
    assert versions.publish(spark.createDataFrame(ROWS[:1], SCHEMA), folder) == 3
    assert rows_of(versions.read_table(spark, folder)) == ROWS[:1]


def test_the_later_of_two_writers_fails(spark, folder, monkeypatch):
    real = versions._switch

    def late(s, where, number, text):
        real(s, where, number, text)  # another writer was first
        real(s, where, number, text)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versions, "_switch", late)
        versions.publish(spark.createDataFrame(ROWS[:2], SCHEMA), folder)
    assert versions.listing(spark, folder)["version"] == 2


def test_unknown_layers_take_no_effect(spark, folder):
    for layer in ("attic", None):
        with pytest.raises(ValueError):
            versions.publish(spark.createDataFrame([("q", layer, "1", 1)], SCHEMA), folder)
    with pytest.raises(ValueError):
        versions.publish(spark.createDataFrame([ROWS[0]], SCHEMA), folder, ["vessel"])
    assert rows_of(versions.read_table(spark, folder)) == sorted(ROWS)


def test_changes_rewrite_their_layers_only(spark, folder):
    assert versions.publish_changes(spark.createDataFrame(ROWS, SCHEMA), folder) is None
    new = [("b", "vessel", "2", 20), ("e", "vessel", "1", 5), ROWS[0]]
    assert versions.publish_changes(spark.createDataFrame(new, SCHEMA), folder) == 2
    assert versions.listing(spark, folder)["layers"] == {"shared": 1, "community": 1, "vessel": 2}
    assert rows_of(versions.read_table(spark, folder)) == sorted([ROWS[0], ROWS[2], ROWS[3], *new[:2]])
    assert versions.publish_changes(spark.createDataFrame(new, SCHEMA), folder) is None


def test_relayering_rewrites_two_layers(spark, folder):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "path string")
    with pytest.raises(ValueError):
        versions.relayer_table(names("b", "nobody"), folder)
    assert versions.relayer_table(names("a"), folder) is None  # it is in another layer
    assert versions.relayer_table(names("b", "b"), folder) == 2
    assert sorted(p.name for p in Path(folder, "data", "version=2").glob("layer=*")) == ["layer=community", "layer=vessel"]
    assert versions.listing(spark, folder)["layers"] == {"shared": 1, "community": 2, "vessel": 2}
    assert versions.relayer_table(names("b"), folder) is None
    assert versions.relayer_table(names("c"), folder) == 3
    assert versions.read_table(spark, folder, ["vessel"]).collect() == []
    assert rows_of(versions.read_table(spark, folder)) == sorted([(p, "community" if x == "vessel" else x, h, n) for p, x, h, n in ROWS])


def test_tables_of_a_batch_appear_together(spark, tmp_path, monkeypatch):
    one, two = spark.range(3), spark.range(5)
    bad = spark.range(2).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception):
        versions.write_together({"one": one, "bad": bad}, str(tmp_path), "b1")
    assert not (tmp_path / "b1").exists()
    path = versions.write_together({"one": one, "two": two}, str(tmp_path), "b1")
    assert sorted(p.name for p in Path(path).iterdir() if p.is_dir()) == ["one", "two"] and spark.read.parquet(f"{path}/two").count() == 5
    with pytest.raises(FileExistsError):
        versions.write_together({"one": one}, str(tmp_path), "b1")
