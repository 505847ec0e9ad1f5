"""Tables written to the folder that all executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session (tests) may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or FALLBACK_DIR


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes with the session."""
    path = f"{shared_dir(spark).rstrip('/')}/hybridkb-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, so that plans which use it several times compute it once,
    a lost executor costs a reread, and its size is known to the joins that follow. The files go with the session."""
    path = fresh_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


BROADCAST_ROWS = 500_000  # of terms or phrases, with BROADCAST_BYTES of text at most
BROADCAST_BYTES = 32 << 20


def size_hint(table: DataFrame, *texts: str) -> str:
    """The join strategy for a staged table: broadcast only within a count of rows and bytes."""
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.length(c) for c in texts), F.lit(8))), F.lit(0))).first()
    return "broadcast" if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else "shuffle_merge"


def rename_suffix(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give the files of a folder another suffix, file by file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(path) if old != new else []:
        name = f.getPath().getName()
        if name.endswith(old):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, name[: -len(old)] + new))
