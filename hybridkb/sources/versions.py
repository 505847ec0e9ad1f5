"""A table in a folder, partitioned by layer and replaced by versions.

A version's rows are written beside the older ones; it takes effect when its list, which says in which version's
folder each layer lies, gets its name by a rename. Until then readers see the version before, also when a run dies on
the way; what it left is never read, and goes with the next clean-up. A version rewrites the layers that it
changes and points to the others. Of two writers, the later rename fails and takes no effect.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType

from hybridkb.sources.tables import LAYERS, relayer, upsert_source


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _numbers(spark: SparkSession, path: str, pattern: str) -> list[int]:
    return sorted(int(m[1]) for name in _names(spark, path) if (m := re.fullmatch(pattern, name)))


def listing(spark: SparkSession, folder: str) -> dict:
    """version, layers (layer to the version whose folder holds it) and schema of the newest version; 0 for none."""
    done = _numbers(spark, f"{folder}/lists", r"(\d+)\.json")
    if not done:
        return {"version": 0, "layers": {}, "schema": None}
    return json.loads(spark.read.text(f"{folder}/lists/{done[-1]}.json", wholetext=True).first()[0])


def read_table(spark: SparkSession, folder: str, layers: list[str] | None = None) -> DataFrame:
    """The rows of the newest version, with ``layer`` and ``version`` as partition columns; of some layers, only their
    folders are listed and read."""
    now = listing(spark, folder)
    if now["schema"] is None:
        raise FileNotFoundError(f"no version in {folder}")
    schema = StructType.fromJson(now["schema"]).add("version", IntegerType()).add("layer", StringType())
    paths = [f"{folder}/data/version={v}/layer={x}" for x, v in now["layers"].items() if layers is None or x in layers]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*paths)


def publish(rows: DataFrame, folder: str, layers: list[str] | None = None) -> int:
    """Write a new version in which ``rows`` are all rows of ``layers`` (all known ones if None), and return its number.
    Rows of another layer, or without one, are an error, and the version does not take effect."""
    spark = rows.sparkSession
    layers = list(LAYERS) if layers is None else layers
    now = listing(spark, folder)
    number = max([now["version"], *_numbers(spark, f"{folder}/data", r"version=(\d+)")]) + 1
    rows = rows.drop("version")
    rows.write.partitionBy("layer").parquet(f"{folder}/data/version={number}")
    written = [n.removeprefix("layer=") for n in _names(spark, f"{folder}/data/version={number}") if n.startswith("layer=")]
    if strange := sorted(set(written) - set(layers)):
        raise ValueError(f"rows of layers that this version does not replace: {strange}")
    schema = StructType([f for f in rows.schema.fields if f.name != "layer"])
    kept = {x: v for x, v in now["layers"].items() if x not in layers} | dict.fromkeys(sorted(written), number)
    _switch(spark, folder, number, json.dumps({"version": number, "layers": kept, "schema": schema.jsonValue()}))
    return number


def _switch(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """Put the version's list under its name; the name appears at once with all of its text, or not at all."""
    fs, draft = _files(spark, f"{folder}/drafts/{number}.json")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, final = _files(spark, f"{folder}/lists/{number}.json")
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {number} of {folder} was published by another writer")


def clean_up(spark: SparkSession, folder: str) -> list[int]:
    """Delete the folders of versions that the newest list does not name, such as half-written ones, and return their
    numbers. Not while another run writes or still reads an older version."""
    named = set(listing(spark, folder)["layers"].values())
    gone = [v for v in _numbers(spark, f"{folder}/data", r"version=(\d+)") if v not in named]
    for v in gone:
        fs, p = _files(spark, f"{folder}/data/version={v}")
        fs.delete(p, True)
    return gone


def publish_changes(incoming: DataFrame, folder: str) -> int | None:
    """Publish the incoming rows (layer, path, content_hash and others) that are new or changed, by rewriting their
    layers; None if nothing changed, or the version's number."""
    spark = incoming.sparkSession
    if listing(spark, folder)["schema"] is None:
        return publish(incoming, folder)
    stored = read_table(spark, folder).drop("version")
    old = stored.select("layer", "path", "content_hash")
    fresh = incoming.select("layer", "path", "content_hash").join(old, ["layer", "path", "content_hash"], "left_anti")
    touched = sorted(r[0] for r in fresh.select("layer").distinct().collect())  # three at most, else publish refuses
    if not touched:
        return None
    return publish(upsert_source(stored.where(stored["layer"].isin(touched)), incoming.where(incoming["layer"].isin(touched))), folder, touched)


def relayer_table(names: DataFrame, folder: str) -> int | None:
    """Move the named sources (path) from vessel to community: only these two layers are read and rewritten. Names that
    the table does not know are an error; None if nothing is left to move."""
    spark = names.sparkSession
    named = names.select("path").distinct()
    strange = named.join(read_table(spark, folder), "path", "left_anti").limit(20).collect()
    if strange:
        raise ValueError(f"unknown sources: {sorted(str(r[0]) for r in strange)}")
    if read_table(spark, folder, ["vessel"]).join(named, "path", "left_semi").isEmpty():
        return None
    both = ["community", "vessel"]
    return publish(relayer(read_table(spark, folder, both), named), folder, both)


def write_together(tables: dict[str, DataFrame], folder: str, batch: str) -> str:
    """Write the tables of a batch below one folder that gets its name when all of them are there, and return it. Readers
    see all tables of a batch or none; a batch that is there already is an error."""
    spark = next(iter(tables.values())).sparkSession
    fs, final = _files(spark, f"{folder}/{batch}")
    if fs.exists(final):
        raise FileExistsError(f"{folder}/{batch}")
    _, draft = _files(spark, f"{folder}/_draft-{batch}")
    fs.delete(draft, True)  # of a run that did not end
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/_draft-{batch}/{name}")
    if not fs.rename(draft, final):
        raise RuntimeError(f"{folder}/{batch} was not published")
    return f"{folder}/{batch}"
