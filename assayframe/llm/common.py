"""Shared helpers: table access, staged tables in the shared folder, seeds."""
from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none and all runs on one machine, as in tests, a
    temporary folder is made and remembered in the session.  A cluster has to
    name a folder: executors could not see each other's temporary ones.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="assayframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/assayframe/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor never forces the work before it to
    run again, and a non-deterministic order is fixed once.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live DataFrame needs."""
    for _ in range(2):  # the first round drops Python's references, the second Spark's
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    """crc32 of an id written as text, modulo ``n`` (null ids count as '')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n
